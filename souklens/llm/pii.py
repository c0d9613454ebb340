"""Personal data: base patterns, and further spans by boosted trees over candidate spans.

High-recall generators propose overlapping spans that look like an address, a number or a name of a
host. A candidate that lies on a base span of its kind counts as found; one off them that fails the kind's
checks or lies on a base span of another kind is known to be wrong. Boosted trees learn both from format
and context, without the signs that the base patterns ask for. The other candidates have no label, however
many they are; they are added where the share of found ones among the labelled at their score is high enough.

Secrets (keys, tokens, passwords) have no base pattern. A run of letters and digits that is assigned to a
name for secrets, or has a vendor's prefix, counts as found; one beside a name for check sums, revisions or
places, or without a digit or a letter, is known to be wrong. The rest is decided by its format. Trees are
fitted on the texts of one hash half, thresholds are set on those of the other.

All work on texts is in SQL functions. The trees are fitted on a table with one row per combination
of features, and become a CASE expression.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no text makes a match go back and forth: a run that
# can't begin a match is skipped whole, and repeats that nothing follows are possessive.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Texts without the sign have no base span of the kind.
SIGN = {"email": "@", "phone": "+"}

#: Candidate generators, wider than the base patterns.
WIDE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:@|\x20?[(\[](?:at|AT)[)\]]\x20?)[A-Za-z0-9-]++(?:(?:\.|\x20?[(\[](?:dot|DOT)[)\]]\x20?)[A-Za-z0-9-]+)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:(?:\.|\[\.\])[0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20.-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])[(]?[0-9]{1,4}[\x20().-]{1,2}[0-9]{2,4}(?:[\x20().-]{1,2}[0-9]{2,4}){1,3}(?![0-9])",
}
#: Kinds that only the method finds, with their generator: long runs that may be keys, tokens or passwords.
ADDED = {"secret": r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9][A-Za-z0-9+/_-]{10,}+={0,2})(?!@|\.[A-Za-z0-9])"}
ALL_KINDS = (*KINDS, *ADDED)
GENERATORS = {**WIDE, **ADDED}
#: Names for secrets before a sign of assignment, and names for what only looks like one.
ASSIGNED = r"(?i)(?:token|secret|passw(?:or)?d|passwd|pwd|passphrase|api_?-?key|access_?-?key|auth|bearer|credential)[\"']?\s*(?:[:=]\s*|=>\s*)?[\"']?$"
NO_SECRET = r"(?i)(?:commit|sha-?[0-9]*|hash|digest|checksum|md5|uuid|guid|etag|rev(?:ision)?|isbn|doi|https?:/|/)[\"']?\s*[:=]?\s*[\"']?$"
#: Prefixes that vendors give their keys.
VENDOR = r"^(?:AKIA|ASIA)[A-Z0-9]{16}$|^gh[opsu]_[A-Za-z0-9]{36}|^sk[-_](?:live|test|proj)?[-_]?[A-Za-z0-9]{20}|^xox[abp]-[0-9A-Za-z-]{10}|^AIza[A-Za-z0-9_-]{35}$|^glpat-[A-Za-z0-9_-]{20}"
CONTEXT = 16
#: Words before a span that speak for its kind.
CUES = {"email": "mail|contact|write|kontakt|correo", "ip": r"\bip\b|host|server|addr", "card": "card|visa|karte|tarjeta|carte|iban", "phone": "tel|phone|call|fax|mobil|appel",
        "secret": "key|login|user|cred|config|env|export"}

ROUNDS, DEPTH, RATE = 24, 2, 0.3
#: Share of found among labelled candidates that a score needs, by each kind's calibration.
PRECISION = 0.95
FEATURES = ("digits", "groups", "seps", "tail", "cue", "before", "after")


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a digit string's check sum is a multiple of ten."""
    turned, n = F.reverse(digits), F.length(digits)

    def add(total: Column, i: Column) -> Column:
        v = F.substr(turned, i, F.lit(1)).cast("int") * (2 - i % 2)
        return total + v - F.when(v > 9, 9).otherwise(0)

    return (F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10) == 0


def _holds(kind: str, m: Column) -> Column:
    """The checks of a base match."""
    n = F.length(_digits(m))
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        part = lambda p: F.length(F.ltrim(p, F.lit("0"))) <= F.when(F.ltrim(p, F.lit("0")) > "255", 2).otherwise(3)
        return F.forall(F.split(m, r"\."), part)
    if kind == "card":
        # longer runs are no cards: their digits aren't added up
        return F.when(n.between(13, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(9, 15)


def _located(df: DataFrame, text: str, pattern: str, out: str, sign: str | None) -> DataFrame:
    """Adds ``out``: the matches of ``pattern`` in order, as (start, end, m, left, right) in code points.

    Pieces between matches and matches are each found once; positions are their running lengths.
    """
    has = F.contains(F.col(text), F.lit(sign)) if sign else F.lit(True)
    df = df.withColumn("_m", F.when(has, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))).otherwise(F.array().cast("array<string>")))
    df = df.withColumn("_p", F.when(F.size("_m") > 0, F.split(F.col(text), pattern, -1)).otherwise(F.array().cast("array<string>")))
    empty = F.array().cast("array<struct<start:int,end:int,m:string,left:string,right:string>>")

    def step(state: Column, i: Column) -> Column:
        m, gap = F.get("_m", i), F.get("_p", i)
        start = state["at"] + F.char_length(gap)
        end = start + F.char_length(m)
        one = F.struct(start.alias("start"), end.alias("end"), m.alias("m"), F.right(gap, F.lit(CONTEXT)).alias("left"), F.left(F.get("_p", i + 1), F.lit(2)).alias("right"))
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(one)).alias("out"))

    places = F.when(F.size("_m") > 0, F.sequence(F.lit(0), F.size("_m") - 1)).otherwise(F.array().cast("array<int>"))
    # blocks of matches, so that the growing array that each step copies stays short
    start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size("_m") - 1) / 256).cast("int")), lambda b: F.slice(places, b * 256 + 1, F.lit(256)))

    def block(state: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(state["at"].alias("at"), empty.alias("out")), step)
        return F.struct(done["at"].alias("at"), F.concat(state["out"], done["out"]).alias("out"))

    located = F.when(F.size("_m") == 0, empty).when(F.size("_m") <= 256, F.aggregate(places, start, step)["out"]).otherwise(F.aggregate(blocks, start, block)["out"])
    return df.withColumn(out, located).drop("_m", "_p")


def _features(kind: str, c: Column) -> Column:
    """Small whole numbers that describe a candidate's format and surroundings."""
    m = c["m"]
    flag = lambda test, v: F.when(test, v).otherwise(0)
    if kind in ADDED:
        return _run_features(c)
    letter = lambda s: F.when(s == "", 0).when(s.rlike("[A-Za-z0-9]"), 3).when(s.rlike(r"[\s]"), 1).otherwise(2)
    return F.struct(
        F.least(F.length(_digits(m)), F.lit(20)).alias("digits"),
        F.least(F.size(F.split(m, "[^0-9]+" if kind != "email" else r"\.")), F.lit(9)).alias("groups"),
        (flag(m.contains("."), 1) + flag(m.contains("-"), 2) + flag(m.contains(" "), 4) + flag(m.contains("("), 8)).alias("seps"),
        F.least(F.length(F.regexp_extract(m, "([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1)), F.lit(9)).alias("tail"),
        flag(F.lower(c["left"]).rlike(CUES[kind]), 1).alias("cue"),
        letter(F.right(F.regexp_replace(c["left"], r"\+$", ""), F.lit(1))).alias("before"),
        letter(F.left(c["right"], F.lit(1))).alias("after"),
    )


def _run_features(c: Column) -> Column:
    """The same features for runs of letters and digits: how mixed they are takes the place of groups and ends."""
    m = c["m"]
    flag = lambda test, v: F.when(test, v).otherwise(0)
    turns = F.size(F.regexp_extract_all(m, F.lit("[0-9][A-Za-z]|[A-Za-z][0-9]"), F.lit(0)))
    share = F.floor(10 * F.length(_digits(m)) / F.length(m)).cast("int")
    different = F.size(F.array_distinct(F.split(F.left(m, F.lit(64)), "")))
    side = lambda s: F.when(s == "", 0).when(s.rlike(r"[\"']"), 2).when(s.rlike("[:=]"), 3).otherwise(1)
    return F.struct(
        share.alias("digits"),
        F.least(turns, F.lit(9)).alias("groups"),
        (flag(m.rlike("[a-z]"), 1) + flag(m.rlike("[A-Z]"), 2) + flag(m.rlike("[+/=]"), 4) + flag(m.rlike("[_-]"), 8) + flag(m.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), 16)).alias("seps"),
        F.least(F.floor(different / 3).cast("int"), F.lit(9)).alias("tail"),
        flag(F.lower(c["left"]).rlike(CUES["secret"]), 1).alias("cue"),
        side(F.right(F.rtrim(c["left"]), F.lit(1))).alias("before"),
        F.least(F.floor(F.length(m) / 8).cast("int"), F.lit(9)).alias("after"),
    )


def _overlaps(c: Column, spans: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))


# SQL functions count a lambda's parameters, so what depends on the kind is closed over


def _checked(kind: str):
    return lambda c: _holds(kind, c["m"])


def _fails(kind: str, c: Column) -> Column:
    """Whether a candidate off the base spans of its kind is known to be wrong: by the kind's checks, or as another kind's base span."""
    m = F.regexp_replace(c["m"], r"[\[\]]", "") if kind == "ip" else c["m"]
    holds = m.rlike("[A-Za-z][A-Za-z0-9-]*$") if kind == "email" else _holds(kind, m)
    other = F.lit(False)
    for k in KINDS:
        if k != kind:
            other = other | _overlaps(c, F.col(f"base_{k}"))
    return ~holds | other


def _secret(c: Column) -> tuple[Column, Column]:
    """Whether a run is a secret by its name or prefix, and whether it is known to be none."""
    m = c["m"]
    other = F.lit(False)
    for k in KINDS:
        other = other | _overlaps(c, F.col(f"base_{k}"))
    wrong = other | ~m.rlike("[0-9]") | ~m.rlike("[A-Za-z]") | c["left"].rlike(NO_SECRET)
    return ~wrong & (c["left"].rlike(ASSIGNED) | m.rlike(VENDOR)), wrong


def _described(kind: str):
    def describe(c: Column) -> Column:
        if kind in ADDED:
            known, wrong = _secret(c)
            return F.struct(c["start"].alias("start"), c["end"].alias("end"), known.alias("found"), wrong.alias("wrong"), _features(kind, c).alias("f"))
        found = _overlaps(c, F.col(f"base_{kind}"))
        return F.struct(c["start"].alias("start"), c["end"].alias("end"), found.alias("found"), (~found & _fails(kind, c)).alias("wrong"), _features(kind, c).alias("f"))

    return describe


def _named(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["found"].alias("found"), c["wrong"].alias("wrong"), c["f"].alias("f"))


def _bare(kind: str):
    return lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"))


def _is(kind: str):
    return lambda c: c["kind"] == kind


def candidates(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep``, ``text``, and by kind its base spans ``base_*`` and candidates ``wide_*`` with features, ``found`` and ``wrong``."""
    df = docs.select(*[docs[c].alias(f"k{i}") for i, c in enumerate(keep)], F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    for kind in KINDS:
        df = _located(df, "text", BASE[kind], f"base_{kind}", SIGN.get(kind))
        df = df.withColumn(f"base_{kind}", F.filter(f"base_{kind}", _checked(kind)))
    for kind in ALL_KINDS:
        df = _located(df, "text", GENERATORS[kind], f"wide_{kind}", None)
        df = df.withColumn(f"wide_{kind}", F.transform(f"wide_{kind}", _described(kind)))
    return df


# -- boosted trees on the table of feature combinations


def _gain(rows: list, feature: str, cut: int) -> float:
    total = 0.0
    for side in (True, False):
        own = [r for r in rows if (r["x"][feature] <= cut) is side]
        if not own:
            return 0.0
        g, h = sum(r["g"] for r in own), sum(r["h"] for r in own)
        total += g * g / (h + 1)
    return total


def _grow(rows: list, depth: int):
    """A regression tree on gradients: nested (feature, cut, low, high), or a leaf's value."""
    g, h = sum(r["g"] for r in rows), sum(r["h"] for r in rows)
    best = max(((_gain(rows, f, c), f, c) for f in FEATURES for c in sorted({r["x"][f] for r in rows})[:-1]), default=(0.0,)) if depth else (0.0,)
    if best[0] <= g * g / (h + 1) + 1e-6:
        return RATE * g / (h + 1)
    _, f, c = best
    return f, c, _grow([r for r in rows if r["x"][f] <= c], depth - 1), _grow([r for r in rows if r["x"][f] > c], depth - 1)


def _value(tree, x: dict) -> float:
    while isinstance(tree, tuple):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def boost(table: list[tuple[dict, int, int]]) -> tuple[float, list]:
    """Start value and trees for rows of (features, found, labelled), by logistic loss."""
    rows = [{"x": x, "p": p, "n": n} for x, p, n in table]
    base = math.log((sum(r["p"] for r in rows) + 0.5) / (sum(r["n"] - r["p"] for r in rows) + 0.5))
    for r in rows:
        r["s"] = base
    trees = []
    for _ in range(ROUNDS):
        for r in rows:
            q = 1 / (1 + math.exp(-max(-30.0, min(30.0, r["s"]))))
            r["g"], r["h"] = r["p"] - r["n"] * q, r["n"] * q * (1 - q)
        tree = _grow(rows, DEPTH)
        trees.append(tree)
        for r in rows:
            r["s"] += _value(tree, r["x"])
    return base, trees


class Model:
    """Trees and threshold of each kind.

    ``tables`` has (features, found, labelled) of each kind for the half that fits and the half that
    calibrates; if either lacks found ones, both do both.
    """

    def __init__(self, tables: dict[str, tuple[list, list]]):
        self.trees, self.least = {}, {}
        for kind, (own, other) in tables.items():
            if not any(p for _, p, _ in own) or not any(p for _, p, _ in other):
                own = other = own + other
            if not own:
                continue
            base, trees = self.trees[kind] = boost(own)
            scored = sorted(((base + sum(_value(t, x) for t in trees), p, n) for x, p, n in other), key=lambda r: r[0], reverse=True)
            least, p_sum, n_sum = math.inf, 0, 0
            for i, (s, p, n) in enumerate(scored):
                p_sum, n_sum = p_sum + p, n_sum + n
                last_of_score = i + 1 == len(scored) or scored[i + 1][0] < s - 1e-9
                if last_of_score and p_sum and p_sum >= PRECISION * n_sum:
                    least = s - 1e-9
            self.least[kind] = least

    def score(self, kind: str, f: Column) -> Column:
        base, trees = self.trees[kind]

        def case(tree) -> Column:
            return F.when(f[tree[0]] <= tree[1], case(tree[2])).otherwise(case(tree[3])) if isinstance(tree, tuple) else F.lit(float(tree))

        total = F.lit(float(base))
        for t in trees:
            total = total + case(t)
        return total


def train(found: DataFrame) -> Model:
    """Fits on the labelled candidates of all texts, found or known to be wrong, counted by their features.

    Only counts leave the executors: whole numbers in small ranges, some thousand rows at most of
    which the corpus has a few hundred.
    """
    each = F.concat(*[F.transform(f"wide_{k}", _named(k)) for k in ALL_KINDS])
    half = F.pmod(F.xxhash64("text"), F.lit(2)).alias("half")
    counted = (found.select(half, F.explode(each).alias("c")).select("half", "c.*").filter("found OR wrong")
               .groupBy("kind", "half", "f").agg(F.sum(F.col("found").cast("long")).alias("p"), F.count("*").alias("n")).collect())
    tables: dict[str, tuple[list, list]] = {k: ([], []) for k in ALL_KINDS}
    for r in sorted(counted, key=lambda r: (r["kind"], r["half"], tuple(r["f"]))):
        tables[r["kind"]][r["half"]].append((r["f"].asDict(), r["p"], r["n"]))
    return Model(tables)


def _added(model: Model, kind: str, least: float):
    new = (lambda c: ~c["found"]) if kind in KINDS else (lambda c: F.lit(True))
    return lambda c: new(c) & ~c["wrong"] & (model.score(kind, c["f"]) >= least) & ~_overlaps(c, F.col("base"))


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find(docs: DataFrame, text_col: str = "text", keep: list[str] = ("doc_id",), model: Model | None = None) -> DataFrame:
    """Personal data in every text: ``keep``, ``text_`` (null: empty), ``base`` and ``spans``.

    ``base`` and ``spans`` are arrays of (kind, start, end) in code points, end exclusive, ordered by
    kind (email, ip, card, phone, secret) and start. Base spans are the leftmost matches of each kind that
    pass its check and may overlap across kinds; the others overlap no base span and none before them.
    Rows stay as given; texts without spans have empty arrays. Without candidates nothing is learned
    and ``spans`` is ``base``.
    """
    keep = list(keep)
    found = candidates(docs, text_col, keep)
    model = model or train(found)
    base = F.concat(*[F.transform(f"base_{k}", _bare(k)) for k in KINDS])
    df = found.withColumn("base", base)
    extra = F.array().cast(_SPANS)
    for kind in ALL_KINDS:
        least = model.least.get(kind, math.inf)
        if least < math.inf:
            extra = F.concat(extra, F.transform(F.filter(f"wide_{kind}", _added(model, kind, least)), _bare(kind)))
    df = df.withColumn("extra", extra)
    # generators overlap: of the added spans the leftmost stays
    by_start = F.sort_array(F.transform("extra", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    free = F.aggregate(by_start, F.array().cast(_SPANS), lambda out, c: F.when(_overlaps(c, out), out).otherwise(F.concat(out, F.array(F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"))))))
    df = df.withColumn("extra", F.when(F.size("extra") > 1, free).otherwise(F.col("extra")))
    own = lambda k: F.sort_array(F.concat(F.filter("base", _is(k)), F.filter("extra", _is(k))))
    spans = F.when(F.size("extra") == 0, F.col("base")).otherwise(F.concat(*[own(k) for k in ALL_KINDS]))
    return df.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], F.col("text").alias("text_"), "base", spans.alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of all spans, comma-joined."""
    return F.concat_ws(",", F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"].cast("string"), c["end"].cast("string"))))


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, _is(kind))).cast("long")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with each span of personal data replaced by its kind in brackets; a null text stays null.

    Overlapping spans become one, named by the first kind. Rows and other columns stay as they are.
    """
    names = docs.columns
    found = find(docs, text_col, names)
    ordered = F.sort_array(F.transform("spans", lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"))))
    cut = "array<struct<start:int,end:int,kind:string>>"

    def merge(out: Column, c: Column) -> Column:
        last = F.element_at(out, -1)
        joined = F.struct(last["start"].alias("start"), F.greatest(last["end"], c["end"]).alias("end"), last["kind"].alias("kind"))
        return F.when((F.size(out) > 0) & (c["start"] < F.try_element_at(out, F.lit(-1))["end"]), F.concat(F.slice(out, 1, F.size(out) - 1), F.array(joined))).otherwise(F.concat(out, F.array(c)))

    df = found.withColumn("cuts", F.when(F.size("spans") > 1, F.aggregate(ordered, F.array().cast(cut), merge)).otherwise(ordered))
    text = F.col("text_")

    def piece(c: Column, i: Column) -> Column:
        begin = F.when(i == 0, 0).otherwise(F.get("cuts", i - 1)["end"])
        return F.concat(F.substr(text, begin + 1, c["start"] - begin), F.lit("["), F.upper(c["kind"]), F.lit("]"))

    end = F.element_at("cuts", -1)["end"]
    cleaned = F.concat(F.concat_ws("", F.transform("cuts", piece)), F.substr(text, end + 1, F.char_length(text)))
    new = F.when(F.size("cuts") > 0, cleaned).otherwise(F.col(text_col))
    return df.select(*[new.alias(text_col) if c == text_col else F.col(c) for c in names])
