"""Mapping free-entered values to a canonical list.

Distinct values are normalised, candidates are retrieved through an inverted
index of character n-grams, scored by cosine with inverse-frequency weights,
and the best is accepted above a threshold and a margin over the next entry.
An exact check of the words then confirms that the value spells the name and
does not merely share words with it. The cosine is over words, whose likeness
(typing errors, sounds, abbreviations) is measured letter by letter.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from noteweave.functions.lookalike import plain
from noteweave.functions.text import percent_decode
from noteweave.session import cut

#: Names of an index that is sent to the workers whole; a longer list is joined by n-gram.
MAX_NAMES = 20_000
#: Least cosine of n-grams at which a name becomes a candidate.
NEAR = 0.20
#: Least weighted cosine of words at which a candidate is accepted, and its lead over the next entry.
THRESHOLD = 0.65
MARGIN = 0.02
GRAM = 3

# Words people put around a name that are no part of it.
NOISE = frozenset("the a an of see re cf todo page pages note notes draft link links file wiki article md top later vs about de la le el der die das und and old_ copy new_ fwd check ref refs".split())
_SPLIT = re.compile(r"[^a-z0-9]+")
_CAMEL = re.compile(r"(?<=[a-zà-öø-ÿ])(?=[A-ZÀ-ÖØ-Þ][a-zà-öø-ÿ])")
# Small words between the words of a name.
CONNECTIVES = ("of", "the", "de", "du", "des", "del", "von", "der")
_FUSED = re.compile(r"(?<=[a-zà-öø-ÿ])of(?=[A-ZÀ-ÖØ-Þ])")
_SLIPPED = re.compile(r"(?<=[a-zà-öø-ÿ])([A-ZÀ-ÖØ-Þ])[ ]+(?=[a-zà-öø-ÿ])")
_EXT = re.compile(r"(?i)\.(?:md|markdown|txt|html?)\b")
_FOLDS = (("ph", "f"), ("ck", "k"), ("c", "k"), ("q", "k"), ("th", "t"), ("z", "s"), ("y", "i"), ("w", "v"))
_DOUBLE = re.compile(r"(.)\1+")


def ascii_words(value: str) -> list[str]:
    """Lower-case ASCII words of a value: decoded, plain, without path, anchor, extension and marks."""
    s = plain(percent_decode(value)) or ""
    s = s.split("#", 1)[0] if s.split("#", 1)[0].strip() else s.replace("#", " ")
    s = _EXT.sub(" ", s)
    head, _, tail = s.rstrip("/ ").rpartition("/")
    s = tail if tail.strip() else head
    s = _SLIPPED.sub(r" \1", _FUSED.sub(" ", s))
    s = _CAMEL.sub(" ", s)
    s = unicodedata.normalize("NFKD", s.replace("ß", "ss").replace("ø", "o").replace("Ø", "O").replace("æ", "ae").replace("œ", "oe").replace("Œ", "Oe").replace("ł", "l").replace("Ł", "L"))
    s = "".join(c for c in s if not unicodedata.combining(c)).casefold()
    return [w for w in _SPLIT.split(s) if w]


def grams(words: list[str]) -> Counter:
    """Character n-grams of each word with a mark at its start and end, and of the whole without blanks."""
    out: Counter = Counter()
    for w in words:
        w = f"^{w}$"
        out.update(w[i : i + GRAM] for i in range(max(1, len(w) - GRAM + 1)))
    if len(words) > 1:
        whole = "".join(words)
        for i in range(len(whole) - GRAM + 1):
            out.setdefault(whole[i : i + GRAM], 1)
    return out


@lru_cache(100_000)
def _sound(w: str) -> str:
    for a, b in _FOLDS:
        w = w.replace(a, b)
    return _DOUBLE.sub(r"\1", w)


@lru_cache(200_000)
def edits(a: str, b: str) -> int:
    """Edit distance with swaps of neighbours."""
    if a == b:
        return 0
    before: list[int] = []
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i] + [0] * len(b)
        for j, y in enumerate(b, 1):
            row[j] = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                row[j] = min(row[j], before[j - 2] + 1)
        before, last = last, row
    return last[-1]


def _in_order(short: str, name: str) -> bool:
    it = iter(name)
    return all(c in it for c in short)


@lru_cache(50_000)
def _abbreviates(name: str, value: str) -> float:
    """Likeness if ``value`` is ``name`` with letters left out, less after one typing error."""
    n, v = len(name), len(value)
    if value[0] == name[0] and 2 <= v < n and (v <= 0.7 * n or v >= 6) and _in_order(value, name):
        return 0.82
    if not 2 <= v <= 6 or v > 0.7 * n:
        return 0.0
    tries = [value[:i] + value[i + 1 :] for i in range(v)] if v >= 3 else []
    tries += [value[:i] + value[i + 1] + value[i] + value[i + 2 :] for i in range(v - 1)] if v >= 3 else []
    return 0.7 if any(t[0] == name[0] and _in_order(t, name) for t in tries) else 0.0


_CONNECTIVE_SOUNDS = frozenset(map(_sound, CONNECTIVES))


@lru_cache(20_000)
def _is_connective(word: str) -> bool:
    """A short word that sounds like a connective, as it stands or after one typing error."""
    if len(word) > 4:
        return False
    slips = [word, *(word[:i] + word[i + 1 :] for i in range(len(word)) if len(word) > 2)]
    return any(_sound(s) in _CONNECTIVE_SOUNDS for s in slips) or any(abs(len(word) - len(w)) <= 1 and edits(w, word) <= 1 for w in ("the", "of"))


@lru_cache(200_000)
def _alike(name: str, value: str) -> float:
    """How well the word ``value`` spells the word ``name``, 0 to 1; abbreviations count."""
    if name == value:
        return 1.0
    n, v = len(name), len(value)
    if v >= 3 and n - v >= 2 and name.startswith(value):
        return 0.92 if v >= 0.5 * n else 0.85
    best = 0.0
    if abs(n - v) <= max(2, n // 3):
        d = min(edits(name, value), edits(_sound(name), _sound(value)) + 0.3)
        if 3 <= d < 4:
            # three edits only if letters were moved about, not replaced
            d = min(d, 1 + max((Counter(name) - Counter(value)).total(), (Counter(value) - Counter(name)).total()))
        if 1 - d / max(n, v) < 0.8 and d >= 2 and name[0] not in value[:2] and value[0] not in name[:2] and _sound(name)[0] != _sound(value)[0]:
            d = 9  # typing errors rarely reach the first letter twice over
        most = 1 if n <= 4 else 2.3 if n <= 10 else 3
        best = max(0.7, 1 - d / max(n, v)) if d <= most and (n > 4 or v > 2) and (n > 5 or name[0] == value[0] or d <= 1) else 0.0
    if best < 0.7:
        if short := _abbreviates(name, value):
            best = max(best, short)
        elif v >= 5 and n - v >= 2 and edits(name[:v], value) <= 1:
            best = max(best, 0.85)
    return best


@lru_cache(50_000)
def _alone(word: str, noise: frozenset[str]) -> bool:
    return word in noise or _is_connective(word)


def stripped(words: list[str], noise: frozenset[str] = NOISE) -> list[str]:
    """The words of a name without those that only stand around names; all of them if nothing else is left."""
    return [w for w in words if w not in noise] or words


def compare(name: list[str], words: list[str], weight: dict[str, float], rare: float, noise: frozenset[str] = NOISE) -> tuple[float, bool]:
    """(weighted cosine of a value and a name, whether the value spells just this name).

    Both are vectors over words with inverse-frequency weights. A word of the
    value that spells a word of the name falls on the same axis, times its
    likeness; every other word has an axis of its own, so what is missing and
    what is left over both lower the cosine. Words typed as one, or parted,
    are compared as a whole. The second value is the exact check: nothing of
    the name is missing and no other word is left over.
    """
    left = [w for w in words if w in name or not _alone(w, noise)]
    if not left:
        return 0.0, False
    size = dot = lost = 0.0
    used: set[int] = set()
    for w in sorted(name, key=lambda w: -weight.get(w, rare)):
        best, at = 0.0, -1
        for j, v in enumerate(left):
            if j in used:
                continue
            a = _alike(w, v)
            if not a and j == len(left) - 1 and len(name) > 1 and w.startswith(v):
                a = 0.75  # cut off while typing
            if a > best:
                best, at = a, j
        square = weight.get(w, rare) ** 2
        size += square
        if best >= 0.6:
            used.add(at)
            dot += square * best
        else:
            lost += square
    extra = [v for j, v in enumerate(left) if j not in used and len(v) > 1]
    spelt = not extra and not lost
    other = size - lost + sum(weight.get(v, rare) ** 2 for v in extra)
    cosine = dot / math.sqrt(size * other) if dot else 0.0
    whole, joined = "".join(name), "".join(left)
    if (not spelt or cosine < 0.9) and len(left) != len(name) and len(whole) >= 6 and abs(len(whole) - len(joined)) <= 3 + len(whole) // 8:
        d = edits(whole, joined)
        if d <= max(1, len(whole) // 5) and (not spelt or 1 - d / len(whole) > cosine):
            cosine, spelt = 1 - d / len(whole), True
    return round(cosine, 9), spelt


Match = tuple[int, float, float]


def decide(words: list[str], found: list[tuple[int, list[str]]], weight: dict[str, float], rare: float, threshold: float = THRESHOLD, margin: float = MARGIN, noise: frozenset[str] = NOISE) -> Match | None:
    """(entry, cosine, margin) of the entry the words mean among the (entry, name) candidates, or None.

    The entry of the highest weighted cosine is accepted if that reaches the
    threshold, leads the next entry the value might spell by the margin, and
    the exact check holds.
    """
    best: dict[int, tuple[float, bool]] = {}
    for entry, name in found:
        this = compare(name, words, weight, rare, noise)
        if this > best.get(entry, (0.0, False)):
            best[entry] = this
    if not best:
        return None
    ranked = sorted(best.items(), key=lambda t: (-t[1][0], -t[1][1], t[0]))
    entry, (cosine, spelt) = ranked[0]
    gap = round(cosine - ranked[1][1][0], 9) if len(ranked) > 1 else 1.0
    return (entry, cosine, gap) if cosine >= threshold and gap >= margin and spelt else None


class Index:
    """Inverted n-gram index over (entry, name) pairs, with the weights of grams and words over all of them."""

    def __init__(self, pairs: list[tuple[int, str]], noise: frozenset[str] = NOISE):
        self.noise = noise
        seen = sorted({(entry, " ".join(stripped(words, noise))) for entry, name in pairs if (words := ascii_words(name))})
        self.entries = [e for e, _ in seen]
        self.names = [name.split(" ") for _, name in seen]
        self.n = max(1, len(seen))
        self.rare = math.log(1 + self.n)
        self.idf = {g: math.log(1 + self.n / k) for g, k in Counter(g for words in self.names for g in grams(words)).items()}
        self.weight = {w: math.log(1 + self.n / k) for w, k in Counter(w for words in self.names for w in set(words)).items()}
        self.postings: dict[str, list[tuple[int, float]]] = {}
        for i, words in enumerate(self.names):
            vector = {g: self.idf[g] * (1 + math.log(k)) for g, k in grams(words).items()}
            norm = math.sqrt(sum(x * x for x in vector.values()))
            for g, x in vector.items():
                self.postings.setdefault(g, []).append((i, x / norm))

    def retrieve(self, words: list[str], near: float = NEAR) -> list[tuple[float, int]]:
        """(n-gram cosine, name) of every name at or above ``near``, best first."""
        vector = {g: self.idf.get(g, self.rare) * (1 + math.log(n)) for g, n in grams(words).items()}
        norm = math.sqrt(sum(x * x for x in vector.values()))
        scores: dict[int, float] = {}
        for g, x in vector.items():
            for i, y in self.postings.get(g, ()):
                scores[i] = scores.get(i, 0.0) + x * y
        return sorted(((c, i) for i, s in scores.items() if (c := round(s / norm, 9)) >= near), key=lambda t: (-t[0], t[1]))

    def match(self, value: str | None, threshold: float = THRESHOLD, margin: float = MARGIN) -> Match | None:
        """(entry, cosine, margin) of the entry ``value`` means, or None."""
        words = ascii_words(value or "")
        if not words:
            return None
        found = [(self.entries[i], self.names[i]) for _, i in self.retrieve(words)]
        return decide(words, found, self.weight, self.rare, threshold, margin, self.noise)


_OUT = "value string, entry bigint, cosine double, margin double"


def _decided(rows: list[tuple[str, Match | None]]) -> pa.RecordBatch:
    cols = list(zip(*[(v, *(m or (None,) * 3)) for v, m in rows], strict=True)) if rows else [()] * 4
    kinds = [pa.string(), pa.int64(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["value", "entry", "cosine", "margin"])


def _names(reference: DataFrame, key: str, title: str, aliases: str) -> DataFrame:
    every = F.array_union(F.array(title), F.coalesce(aliases, F.array().cast("array<string>")))
    return reference.select(F.col(key).cast("long").alias("entry"), F.explode(every).alias("name")).filter("name IS NOT NULL AND trim(name) <> ''").distinct()


def _joined(values: DataFrame, names: DataFrame, threshold: float, margin: float, noise: frozenset[str]) -> DataFrame:
    """The same decisions for a list too long to send about: index, weights and values meet by n-gram and word."""

    def normal(strip: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                words = [ascii_words(t) for t in batch.column(1).to_pylist()]
                there = [i for i, w in enumerate(words) if w]
                text = [" ".join(stripped(words[i], noise) if strip else words[i]) for i in there]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(there, pa.int64())), pa.array(text, pa.string())], [batch.schema.names[0], "words"])

        return run

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, g, 1 + math.log(n)) for i, text in enumerate(batch.column(1).to_pylist()) for g, n in grams(text.split(" ")).items()]
            at, g, tf = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(at, pa.int64())) for c in batch.columns), pa.array(g, pa.string()), pa.array(tf, pa.float64())], [*batch.schema.names, "g", "tf"])

    index = cut(names.select("entry", "name").mapInArrow(normal(True), "entry bigint, words string").distinct())
    asked = values.select("value", F.col("value").alias("text")).mapInArrow(normal(False), "value string, words string")
    n = max(1, index.count())
    rare = math.log(1 + n)
    parts = index.select("entry", "words", F.explode(F.array_distinct(F.split("words", " "))).alias("w"))
    weights = parts.groupBy("w").agg(F.log(1 + F.lit(n) / F.count(F.lit(1))).alias("weight"))
    table = lambda *keys: F.map_from_entries(F.collect_list(F.struct("w", "weight"))).alias(keys[0])
    of_name = parts.join(weights, "w").groupBy("entry", "words").agg(table("of_name"))
    of_value = asked.select("value", F.explode(F.array_distinct(F.split("words", " "))).alias("w")).join(weights, "w").groupBy("value").agg(table("of_value"))

    posted = index.mapInArrow(split, "entry bigint, words string, g string, tf double")
    idf = posted.groupBy("g").agg(F.log(1 + F.lit(n) / F.count(F.lit(1))).alias("idf"))
    posted = posted.join(idf, "g").withColumn("x", F.col("tf") * F.col("idf"))
    norms = posted.groupBy("entry", "words").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    posted = posted.join(norms, ["entry", "words"]).select("g", "entry", "words", (F.col("x") / F.col("norm")).alias("y"))
    sought = asked.mapInArrow(split, "value string, words string, g string, tf double")
    sought = sought.join(idf, "g", "left").select("value", "g", (F.col("tf") * F.coalesce("idf", F.lit(rare))).alias("x"))
    length = sought.groupBy("value").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    scored = sought.join(posted, "g").groupBy("value", "entry", "words").agg(F.sum(F.col("x") * F.col("y")).alias("s"))
    close = scored.join(length, "value").filter(F.round(F.col("s") / F.col("norm"), 9) >= NEAR).join(of_name, ["entry", "words"])
    close = close.groupBy("value").agg(F.collect_list(F.struct("entry", "words", "of_name")).alias("close"))
    ready = asked.join(close, "value").join(of_value, "value", "left").select("value", "words", "close", "of_value")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for value, words, found, known in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                weight = dict(known or ())
                for f in found:
                    weight.update(f["of_name"])
                near = sorted((f["entry"], f["words"].split(" ")) for f in found)
                rows.append((value, decide(words.split(" "), near, weight, rare, threshold, margin, noise)))
            yield _decided(rows)

    return values.select("value").join(ready.mapInArrow(check, _OUT), "value", "left")


def map_values(
    values: DataFrame,
    raw: str,
    reference: DataFrame,
    key: str,
    title: str,
    aliases: str,
    threshold: float = THRESHOLD,
    margin: float = MARGIN,
    max_names: int = MAX_NAMES,
    noise: frozenset[str] = NOISE,
) -> DataFrame:
    """(value, n_rows, entry, cosine, margin): every distinct value and the entry it means.

    Unmatched values, NULL and blank ones among them, are reported with a NULL
    entry. The entry of the highest weighted cosine is taken if the cosine
    reaches ``threshold``, leads the next entry the value spells by ``margin``
    (ties match nothing), and the exact check holds: nothing of the name is
    missing from the value and no other word is left over. ``noise`` names
    words that stand around names and count for nothing. Entries with NULL or
    no aliases have their title alone; repeated rows of either table change
    only n_rows. Of both tables only the named columns are read.

    The names are counted first. Up to ``max_names`` the index goes to the
    workers; a longer list is joined by n-gram instead. Weights come from all
    names either way, so both give the same rows.
    """
    spark = values.sparkSession
    distinct = values.groupBy(F.col(raw).alias("value")).agg(F.count(F.lit(1)).alias("n_rows"))
    names = _names(reference, key, title, aliases)
    pairs = [(r[0], r[1]) for r in names.limit(max_names + 1).collect()]
    if len(pairs) <= max_names:
        index = Index(pairs, noise)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = _decided([(v, index.match(v, threshold, margin)) for v in batch.column(0).to_pylist()])
                yield pa.RecordBatch.from_arrays([found.column(0), batch.column(1), *found.columns[1:]], ["value", "n_rows", *found.schema.names[1:]])

        # scoring costs far more than the bytes say, so the few bytes are spread by hand, in many small tasks:
        # a value may have far more candidates than another
        spread = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 8 * spark.sparkContext.defaultParallelism)
        mapped = distinct.filter("value IS NOT NULL").repartition(spread, "value").mapInArrow(run, _OUT.replace("value string,", "value string, n_rows bigint,"))
    else:
        asked = distinct.select("value").filter("value IS NOT NULL")
        mapped = distinct.filter("value IS NOT NULL").join(_joined(asked, names, threshold, margin, noise), "value")
    empty = distinct.filter("value IS NULL").select("value", "n_rows", *(F.lit(None).cast(t).alias(c) for c, t in (("entry", "long"), ("cosine", "double"), ("margin", "double"))))
    return mapped.select("value", "n_rows", "entry", "cosine", "margin").unionByName(empty)


def meant_entries(values: DataFrame, row_key: str, raw: str, reference: DataFrame, key: str, title: str, aliases: str) -> DataFrame:
    """(row_key, entry): the rows whose value means an entry. Repeated rows give one row."""
    mapped = map_values(values, raw, reference, key, title, aliases).filter("entry IS NOT NULL").select("value", "entry")
    rows = values.select(F.col(row_key).alias("__id"), F.col(raw).alias("value")).filter("value IS NOT NULL")
    return rows.join(mapped, "value").select(F.col("__id").alias(row_key), "entry").distinct()
