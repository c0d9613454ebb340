"""Language identification in two levels: the family first, then the languages within it.

Both levels are one-versus-one linear support vector machines on relative frequencies of hashed byte
trigrams. They are fitted on a bounded sample of labelled rows; every text is then scored whole.
"""

from __future__ import annotations

import re
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from souklens.functions.storage import materialise
from souklens.llm import textbytes as tb

BITS = 13
#: Labelled rows that the machines are fitted on, shared out evenly between the languages, and the rows that each has at least.
SAMPLE_ROWS, LEAST_EACH = 2400, 8
#: Margins that are voted on at once.
VOTED = 1 << 22
#: Penalty of the support vector machines, and rounds of coordinate ascent over the sample.
PENALTY, ROUNDS = 10.0, 60
UNDETERMINED = "und"

# Language families by ISO 639-1 code; a code that is not listed is a family of its own, with its regional tags.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "an ast ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "celtic": "br cy ga gd gv kw",
    "baltic": "lt lv",
    "indo-aryan": "as bn gu hi mr ne or pa si ur",
    "iranian": "fa ku ps tg",
    "dravidian": "kn ml ta te",
    "turkic": "az kk ky tk tr tt ug uz",
    "uralic": "et fi hu se",
    "semitic": "am ar he mt ti",
    "austronesian": "ceb id jv mg mi ms su tl",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    """The family of a code, with or without a region; one that is not listed is that of the code before the region."""
    code = re.split("[-_]", lang.lower())[0]
    return FAMILY_OF.get(code, code)


# Folds A-Z, digits to 0, other ASCII signs and white space to a blank.
_TABLE = tb.FOLD.copy()
_TABLE[:48] = _TABLE[58:65] = _TABLE[91:97] = _TABLE[123:128] = 32
_TABLE[48:58] = 48
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[65:91] = _ASCII_LETTER[97:123] = True


def features(block: tb.Block) -> tuple[np.ndarray, np.ndarray]:
    """The feature of the trigram that begins at each byte, and which of them lie within one text."""
    data = _TABLE[block.data].astype(np.uint64)
    n = max(0, len(data) - 2)
    code = data[:n] | data[1:n + 1] << np.uint64(8) | data[2:n + 2] << np.uint64(16)
    inside = np.ones(n, bool)
    ends = block.offsets[1:]
    for back in (1, 2):
        cut = ends - back
        inside[cut[(cut >= 0) & (cut < n)]] = False
    return (tb.mix(code) >> np.uint64(64 - BITS)).astype(np.int64), inside


def has_letter(block: tb.Block) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(_ASCII_LETTER[block.data], dtype=np.int64)])
    found = np.diff(sums[block.offsets]) > 0
    for i in np.flatnonzero(~found & (np.diff(block.offsets) > 0)).tolist():
        found[i] = any(map(str.isalpha, block.text(i).decode("utf-8", "replace")))
    return found


def pick_sample(rows: DataFrame, size: int) -> DataFrame:
    """As many rows of each language: chosen by a hash, cut before any shuffle of text.

    About ``size`` rows at most, but ``LEAST_EACH`` of every language, however many there are.
    """
    counts = materialise(rows.groupBy("lang").count())
    each = max(LEAST_EACH, size // max(1, counts.count()))
    chance = counts.select(F.col("lang").alias("known"), F.least(F.lit(1.0), (F.lit(1.5 * each) + 10) / F.col("count")).alias("chance"))
    rows = rows.withColumn("draw", F.xxhash64("text", "id"))
    # a row per language: small enough to be broadcast
    near = rows.join(F.broadcast(chance), F.col("lang") == F.col("known")).filter((F.col("draw").cast("double") / 2.0**64 + 0.5) < F.col("chance"))
    ranked = near.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy("draw")))
    return ranked.filter(F.col("place") <= each).select("lang", "text")


class Machines:
    """Linear deciders for pairs of classes: a column of weights and a bias each.

    With more pairs than rows in the sample, the columns are the sample's rows, and ``mix`` has the rows
    of each pair and their factors, so that the size grows with the languages and not with their pairs.
    """

    def __init__(self, families: list[str], languages: dict[str, list[str]]):
        self.families, self.languages = families, languages
        self.pairs = [(None, a, b) for a, b in combinations(families, 2)] + [(f, a, b) for f in families for a, b in combinations(languages[f], 2)]
        self.weights = np.zeros((1 << BITS, 0), np.float32)
        self.mix: list[tuple[np.ndarray, np.ndarray]] | None = None
        self.level: dict[str | None, list[tuple[int, int, int]]] = {}  # pairs of a level, and the places of their classes
        place = {lv: {c: i for i, c in enumerate(cs)} for lv, cs in [(None, families), *languages.items()]}
        for k, (lv, a, b) in enumerate(self.pairs):
            self.level.setdefault(lv, []).append((k, place[lv][a], place[lv][b]))
        self.bias = np.zeros(len(self.pairs))
        self.slope = np.ones(len(self.pairs))

    def margins(self, sums: np.ndarray) -> np.ndarray:
        """The margin of each pair, from a text's products with the columns of ``weights``."""
        if self.mix is None:
            return sums + self.bias
        out = np.empty((len(sums), len(self.pairs)))
        for k, (rows, factor) in enumerate(self.mix):
            out[:, k] = sums[:, rows] @ factor
        return out + self.bias

    def decide_all(self, sums: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each text, a bounded number at a time."""
        lang, score, step = [], np.empty(len(sums)), max(1, VOTED // max(1, len(self.pairs)))
        for a in range(0, len(sums), step):
            own, score[a:a + step] = self.decide(self.margins(sums[a:a + step]))
            lang += own
        return lang, score

    def decide(self, margins: np.ndarray) -> tuple[list[str], np.ndarray]:
        """Language and score of each row of margins: the family by votes of its pairs, then the language."""
        chance = 1 / (1 + np.exp(-np.clip(margins * self.slope, -30, 30)))
        family, sure = self._vote(None, self.families, chance)
        out, score = np.empty(len(margins), object), sure.copy()
        for i, f in enumerate(self.families):
            rows = np.flatnonzero(family == i)
            best, own = self._vote(f, self.languages[f], chance[rows])
            out[rows] = np.array(self.languages[f], object)[best]
            score[rows] *= own
        return out.tolist(), score

    def _vote(self, level: str | None, classes: list[str], chance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        votes = np.zeros((len(chance), len(classes)))
        for k, a, b in self.level.get(level, ()):
            votes[:, a] += chance[:, k]
            votes[:, b] += 1 - chance[:, k]
        best = votes.argmax(axis=1) if len(classes) > 1 else np.zeros(len(chance), np.int64)
        return best, votes[np.arange(len(chance)), best] / (len(classes) - 1) if len(classes) > 1 else np.ones(len(chance))


def fit(sample: list[tuple[str, np.ndarray, np.ndarray]]) -> Machines | None:
    """Fits all pairs on rows of (language, features, relative frequencies)."""
    langs = sorted({x for x, _, _ in sample})
    if not langs:
        return None
    by_family: dict[str, list[str]] = {}
    for code in langs:
        by_family.setdefault(family_of(code), []).append(code)
    out = Machines(sorted(by_family), by_family)
    x = np.zeros((len(sample), 1 << BITS), np.float32)
    for i, (_, at, share) in enumerate(sample):
        x[i, at] = share
    scale = 1 / np.sqrt(x.mean(axis=0) + 1e-5)
    x *= scale
    kernel = x @ x.T + 1.0  # 1 for the bias
    label = np.array([s[0] for s in sample])
    family = np.array([family_of(s[0]) for s in sample])
    few = len(out.pairs) <= len(sample)
    if few:
        out.weights = np.zeros((1 << BITS, len(out.pairs)), np.float32)
    else:
        out.mix = []
    for k, (level, a, b) in enumerate(out.pairs):
        own = family if level is None else label
        rows = np.flatnonzero((own == a) | (own == b))
        y = np.where(own[rows] == a, 1.0, -1.0)
        alpha = support_vectors(kernel[np.ix_(rows, rows)].astype(np.float64), y)
        pull = np.zeros(len(sample), np.float32)
        pull[rows] = alpha * y
        if few:
            out.weights[:, k] = (pull @ x) * scale
        else:
            out.mix.append((rows[alpha > 0].astype(np.int32), pull[rows[alpha > 0]]))
        out.bias[k] = pull.sum()
        out.slope[k] = steepness((kernel[rows] @ pull) * y)
    if not few:
        out.weights = np.ascontiguousarray((x * scale).T)
    return out


def support_vectors(kernel: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dual coordinate ascent for squared hinge loss, in fixed order."""
    n = len(y)
    alpha, score = np.zeros(n), np.zeros(n)
    curve = kernel.diagonal() + 0.5 / PENALTY
    for _ in range(ROUNDS):
        moved = 0.0
        for i in range(n):
            step = (1 - y[i] * score[i] - alpha[i] * 0.5 / PENALTY) / curve[i]
            new = max(0.0, alpha[i] + step)
            if new != alpha[i]:
                score += (new - alpha[i]) * y[i] * kernel[i]
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-4 * max(1.0, alpha.max()):
            break
    return alpha


def steepness(margin: np.ndarray) -> float:
    """Slope of the logistic curve that fits the margins of the sample best."""
    slopes = np.geomspace(0.5, 16, 21)
    return float(min(slopes, key=lambda s: np.logaddexp(0, -s * margin).mean() + 0.001 * s))


def train(rows: DataFrame, size: int = SAMPLE_ROWS) -> Machines | None:
    """Machines from rows ``id, lang, text``: a null ``lang`` or ``text`` is not used."""

    def work(block: tb.Block) -> dict:
        feature, inside = features(block)
        at, share = [], []
        for a, b in zip(block.offsets[:-1].tolist(), block.offsets[1:].tolist()):
            own = feature[a:b][inside[a:b]]
            f, n = np.unique(own, return_counts=True)
            at.append(f.astype("<i4").tobytes())
            share.append((n / max(1, len(own))).astype("<f4").tobytes())
        return {"at": pa.array(at, pa.binary()), "share": pa.array(share, pa.binary())}

    sample = pick_sample(rows.filter("lang IS NOT NULL AND text IS NOT NULL"), size)
    made = tb.map_texts(sample, "text", ["lang"], "at binary, share binary", work).collect()
    made.sort(key=lambda r: (r["lang"], r["at"], r["share"]))
    return fit([(r["lang"], np.frombuffer(r["at"], "<i4"), np.frombuffer(r["share"], "<f4")) for r in made if r["at"]])


def predict(docs: DataFrame, machines: Machines | None, text_col: str = "text", keep: list[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``lang_pred`` and ``score`` (0 to 1) of every text, from the text alone.

    ``und`` with score 0 for a null text, one without a letter, or if nothing was learned. Rows stay as given.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machines)

    def work(block: tb.Block) -> dict:
        m = shared.value
        lettered = has_letter(block)
        if m is None:
            return {"lang_pred": [UNDETERMINED] * len(block), "score": np.zeros(len(block))}
        feature, inside = features(block)
        ends = np.minimum(block.offsets, len(feature))
        count = np.maximum(1, np.diff(np.concatenate([[0], np.cumsum(inside, dtype=np.int64)])[ends]))
        sums = np.empty((len(block), m.weights.shape[1]))
        for k in range(m.weights.shape[1]):
            each = np.where(inside, m.weights[:, k][feature], 0)
            sums[:, k] = np.diff(np.concatenate([[0.0], np.cumsum(each, dtype=np.float64)])[ends]) / count
        lang, score = m.decide_all(sums)
        return {"lang_pred": [x if ok else UNDETERMINED for x, ok in zip(lang, lettered)], "score": np.where(lettered, score, 0.0)}

    return tb.map_texts(docs, text_col, list(keep), "lang_pred string, score double", work)


def held_out(id_col: str) -> Column:
    """Rows that nothing is learned from: CRC-32 of the id as text is 2 modulo 4; false for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, learn_from: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """Fits on the rows of ``learn_from`` that are not held out, and predicts every row of ``docs``."""
    rows = learn_from.filter(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return predict(docs, train(rows), text_col, keep or [id_col])
