"""Language identification by cross-parsing entropy (operator 11).

For every language a suffix automaton holds a bounded sample of its labelled
text.  A document is cross-parsed against each: read from left to right, every
phrase is the longest match that the automaton has at that place (a letter it
does not have at all is a phrase alone).  A phrase costs the logarithm of the
automaton's text length, as it could begin anywhere in it, and the costs are
divided by the letters read: an estimate of the cross entropy.  The language
with the lowest one wins.

The sample: texts are taken in the order of a hash of the text, so copies count
once; of each one passage, cut at a hashed place.  ``total_chars`` bounds all
languages together and ``lang_chars`` each one, whatever the input; it is what
goes to the workers, which build their automata from it once.  Everything else
reads whole texts: letters in lower case, all between them as one space.

Defined results: ``und`` with score 0 for a text that is null or has no letter,
and for all texts where nothing was learned; ties go to the smaller language
name; the score is r2 / (r1 + r2) of the best and second best rate (0.5 to 1;
1 where one language was learned).  Rows with a null id, text or language are
never learned from; a null id is not held out.  Repeated rows stay, and an
empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casework.session import materialize

UNKNOWN = "und"
#: the languages' sizes are broadcast up to so many rows
BROADCAST_ROWS = 10_000
_LETTERS = re.compile(r"[^\W\d_]+")
#: between passages; no normalised text has it
_CUT = "\n"


@dataclass(frozen=True)
class Sample:
    """Bounds of the text that the automata are built from."""

    lang_chars: int = 1 << 15
    total_chars: int = 1 << 20
    passage_chars: int = 512


def normalise(text: str | None) -> str:
    """Letters in lower case with one space between words; empty if there is no letter."""
    text = " ".join(_LETTERS.findall((text or "").lower()))
    return text if any(map(str.isalpha, text)) else ""


def automaton(text: str) -> dict:
    """The root of the suffix automaton of ``text``: a state is the dictionary
    of its next states by letter, and each substring is a path from the root."""
    follow, link, length, last = [{}], [-1], [0], 0
    for c in text:
        here = len(follow)
        follow.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = here
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[here] = q
            else:
                twin = len(follow)
                follow.append(dict(follow[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                link[q] = link[here] = twin
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = twin
                    p = link[p]
        last = here
    for state in follow:
        for c, to in state.items():
            state[c] = follow[to]
    return follow[0]


def phrases(root: dict, text: str) -> int:
    """Longest matches that make up ``text``, read from left to right."""
    n, unseen = 0, {}
    state = unseen
    for c in text:
        state = state.get(c)
        if state is None:
            n += 1
            state = root.get(c, unseen)
    return n


class Languages:
    """Sampled text by language; the automata are built where they are used."""

    def __init__(self, texts: dict[str, list[str]]):
        joined = {lang: _CUT.join(filter(None, map(normalise, own))) for lang, own in sorted(texts.items())}
        self.texts = {lang: t for lang, t in joined.items() if t}
        self._roots = None

    def __getstate__(self):
        return self.texts

    def __setstate__(self, texts):
        self.texts, self._roots = texts, None

    def rates(self, texts: list[str]) -> dict[str, list[float]]:
        """Bits for each letter of normalised texts, by language."""
        if self._roots is None:
            self._roots = {lang: (automaton(t), math.log2(len(t) + 1)) for lang, t in self.texts.items()}
        # language by language: an automaton stays near while all texts pass it
        return {lang: [phrases(root, t) * bits / max(1, len(t)) for t in texts] for lang, (root, bits) in self._roots.items()}

    def identify(self, texts: list[str | None]) -> list[tuple[str, float]]:
        texts = [normalise(t) for t in texts]
        rates = self.rates(texts)
        found = []
        for i, text in enumerate(texts):
            order = sorted((rate[i], lang) for lang, rate in rates.items()) if text else []
            if not order:
                found.append((UNKNOWN, 0.0))
            else:
                found.append((order[0][1], order[1][0] / (order[0][0] + order[1][0]) if len(order) > 1 else 1.0))
        return found


def held_out(id_col: str, folds: int = 3, fold: int = 1):
    """crc32 of the id as text leaves remainder ``fold``."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def learn(docs: DataFrame, sample: Sample = Sample(), id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang") -> Languages:
    """A sample of each language from documents that are not held out."""
    rows = (docs.where(F.col(id_col).isNotNull() & F.col(lang_col).isNotNull() & ~held_out(id_col))
            .select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.trim("text") != "")
            .withColumn("h", F.xxhash64("text")))
    size = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.02).alias("n"))
    size = materialize(size)
    langs = size.count()
    size = size.withColumn("share", F.least(F.lit(sample.lang_chars), F.lit(sample.total_chars // max(1, langs))))
    size = (size.withColumn("take", F.greatest(F.lit(1), F.floor(F.col("share") / sample.passage_chars)))
            # fewer texts give longer passages
            .withColumn("chars", F.greatest(F.lit(sample.passage_chars), F.floor(F.col("share") / F.col("n"))).cast("int")))
    near = F.col("h").cast("double") < (4.0 * F.col("take") / F.col("n")) * 2.0**64 - 2.0**63
    first = Window.partitionBy("lang").orderBy("h")     # about four times ``take`` texts
    begin = F.pmod(F.xxhash64("h", F.lit(1)), F.greatest(F.lit(1), F.length("text") - F.col("chars") + 1)).cast("int") + 1
    taken = (rows.join(F.broadcast(size) if langs <= BROADCAST_ROWS else size, "lang").where(near).dropDuplicates(["lang", "h"])
             .withColumn("i", F.row_number().over(first)).where("i <= take")
             .select("lang", "h", F.substring("text", begin, F.col("chars")).alias("t")))
    texts: dict[str, list[str]] = {}
    for lang, _, t in taken.orderBy("lang", "h").collect():  # at most about total_chars letters
        texts.setdefault(lang, []).append(t)
    return Languages(texts)


def identify(docs: DataFrame, languages: Languages, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, lang, score) of every row."""
    sent = docs.sparkSession.sparkContext.broadcast(languages)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = sent.value.identify(b.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array([f[0] for f in found], pa.string()),
                 pa.array([f[1] for f in found], pa.float64())], ["id", "held_out", "lang", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "id long, held_out boolean, lang string, score double")
