"""METEOR of captions: words aligned stage by stage with as few chunks as can be, after the metric's papers.

Each stage (equal words, equal stems, injected synonyms) aligns what the stages before left, with as many matches as there can be and, of
those alignments, the one that gives the fewest chunks together with the earlier stages' matches. A chunk is a run of matches that are
neighbours in both captions. The search goes through the hypothesis word by word; of partial alignments that use the same
reference words only the best is kept, which is exact. Captions of very many equal words can have more such states than WIDTH; then
the best WIDTH go on, as the papers' own aligner does with fewer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .captions import tokens

WIDTH = 256
#: Weights of recall, fragmentation and its power, and of the stages (fixed values of the first paper; the stages' weights of later ones).
ALPHA, GAMMA, POWER = 0.9, 0.5, 3.0
WEIGHTS = {"exact": 1.0, "stem": 0.6, "synonym": 0.8}


def s_stem(word: str) -> str:
    """Plural endings taken off, by the three rules of the S stemmer."""
    if len(word) > 3 and word.endswith("ies") and not word.endswith(("eies", "aies")):
        return word[:-3] + "y"
    if len(word) > 3 and word.endswith("es") and not word.endswith(("aes", "ees", "oes")):
        return word[:-1]
    if len(word) > 2 and word.endswith("s") and not word.endswith(("us", "ss")):
        return word[:-1]
    return word


def align(h: Sequence[str], r: Sequence[str], same: Callable[[str, str], bool], fixed: dict[int, int]) -> dict[int, int]:
    """`fixed` and more matches (place in h: place in r) between words that aren't matched yet: as many as can be, with the fewest chunks."""
    taken = set(fixed.values())
    near = [[] if i in fixed else [j for j, w in enumerate(r) if j not in taken and same(h[i], w)] for i in range(len(h))]
    # partial alignments: (reference words used that a later word may want too, where the last word stands) -> (-matches, chunks, alignment)
    later = [set() for _ in range(len(h) + 1)]
    for i in range(len(h) - 1, -1, -1):
        later[i] = later[i + 1] | set(near[i])
    states = {(frozenset(), -2): (0, 0, ())}
    for i in range(len(h)):
        new: dict = {}
        for (used, last), (matches, chunks, made) in states.items():
            options = [(fixed[i], 0)] if i in fixed else [(-2, 0), *[(j, 1) for j in near[i] if j not in used]]
            for j, more in options:
                key = (frozenset(used | {j} if more else used) & later[i + 1], j)
                value = (matches - more, chunks + (j >= 0 and j != last + 1), made + ((i, j),) if more else made)
                if key not in new or value < new[key]:
                    new[key] = value
        if len(new) > WIDTH:
            new = dict(sorted(new.items(), key=lambda x: (x[1], x[0][1], sorted(x[0][0])))[:WIDTH])
        states = new
    return fixed | dict(min(states.values())[2])


def chunks(match: dict[int, int]) -> int:
    return sum(match.get(i - 1, -2) + 1 != j for i, j in match.items())


def score_one(h: Sequence[str], r: Sequence[str], stages: Sequence[str], stem: Callable[[str], str], synonyms: Callable[[str, str], bool] | None, alpha: float = ALPHA, gamma: float = GAMMA, power: float = POWER) -> float:
    """The score of one hypothesis against one reference."""
    match: dict[int, int] = {}
    weight = 0.0
    same = {"exact": lambda a, b: a == b, "stem": lambda a, b: stem(a) == stem(b), "synonym": synonyms or (lambda a, b: False)}
    for stage in stages:
        more = align(h, r, same[stage], match)
        weight += WEIGHTS[stage] * (len(more) - len(match))
        match = more
    if not match or not weight:
        return 0.0
    p, q = weight / len(h), weight / len(r)
    return p * q / (alpha * p + (1 - alpha) * q) * (1 - gamma * (chunks(match) / len(match)) ** power)


def meteor(df: DataFrame, key: str, hypothesis: str, references: str, stages: Sequence[str] = ("exact", "stem"), stem: Callable[[str], str] = s_stem, synonyms: Callable[[], Callable[[str, str], bool]] | None = None) -> DataFrame:
    """(key, meteor): the best score over a row's references; 0 for captions without words, null hypotheses or no references.

    synonyms, if stages has `synonym`, makes the test of two words once a task. One narrow pass, nothing is shuffled.
    """
    if set(stages) - set(WEIGHTS):
        raise ValueError(f"unknown stages {sorted(set(stages) - set(WEIGHTS))}")
    kind = df.schema[key].dataType.simpleString()
    slim = df.select(F.col(key).alias("key"), F.coalesce(tokens(hypothesis), F.array()).alias("h"), F.coalesce(F.filter(F.transform(references, tokens), lambda x: x.isNotNull()), F.array()).alias("rs"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = synonyms() if synonyms else None
        for b in batches:
            scores = [max((score_one(h, r, stages, stem, test) for r in rs if r and h), default=0.0) for h, rs in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=[key, "meteor"])

    return slim.mapInArrow(run, f"`{key}` {kind}, meteor double")


__all__ = ["align", "chunks", "meteor", "s_stem", "score_one"]
