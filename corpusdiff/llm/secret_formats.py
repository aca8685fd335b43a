"""Secret scans with inferred grammars.

Base patterns find credentials of three kinds. Their values are the labelled examples of the formats: for each kind a prefix tree of the values is built, and
states whose outgoing and ending frequencies do not differ significantly (Hoeffding bounds) are merged, recursively, into a probabilistic automaton. One more
automaton is inferred from ordinary candidates, which no base pattern covers. Every candidate of every text is then scored: by the log-likelihood per
character of the best credential automaton over the ordinary one. Candidates above the threshold are added as kind ``format``; base spans always stay.

The examples are a documented bounded sample: per kind the ``examples`` distinct values with the smallest hashes (a distributed top-n, after a
partial aggregate). Nothing else is bounded; scanning is one pass over whole texts inside rows, without any shuffle.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusdiff.llm.common import release_memory, stored

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{12,}")
KINDS = ("assign", "access", "hex")
FORMAT = "format"
MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])", re.S)
FEW_OTHERS = 50
SYMBOLS = 68  # letters, digits and six marks: what a candidate consists of, besides its end


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """``(start, end, kind, value)`` by start, then kind as listed."""
    found = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def candidates(text: str, taken: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str]]:
    """Runs of credential characters with a letter and a digit that no base span touches."""
    found, at = [], 0
    spans = sorted((s[0], s[1]) for s in taken)
    reach = 0
    for m in CANDIDATE.finditer(text):
        while at < len(spans) and spans[at][0] < m.end():
            reach = max(reach, spans[at][1])
            at += 1
        if reach <= m.start() and MIXED.match(m[0]):
            found.append((m.start(), m.end(), m[0]))
    return found


@dataclass
class _State:
    through: int = 0
    ends: int = 0
    to: dict = field(default_factory=dict)  # character: (state number, times)


def _differ(f1: int, n1: int, f2: int, n2: int, alpha: float) -> bool:
    if not n1 or not n2:
        return False
    return abs(f1 / n1 - f2 / n2) > math.sqrt(0.5 * math.log(2 / alpha)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))


def infer(values: list[str], alpha: float = 0.05) -> list[_State]:
    """A probabilistic automaton from example strings; state 0 is the start. Reached states only are listed."""
    states = [_State()]
    for value in values:
        at = 0
        for c in value:
            states[at].through += 1
            to, n = states[at].to.get(c, (len(states), 0))
            if not n:
                states.append(_State())
            states[at].to[c] = (to, n + 1)
            at = to
        states[at].through += 1
        states[at].ends += 1

    def compatible(a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            x, y = stack.pop()
            p, q = states[x], states[y]
            if _differ(p.ends, p.through, q.ends, q.through, alpha):
                return False
            for c in p.to.keys() | q.to.keys():
                (s, n), (t, m) = p.to.get(c, (-1, 0)), q.to.get(c, (-1, 0))
                if _differ(n, p.through, m, q.through, alpha):
                    return False
                if n and m:
                    stack.append((s, t))
        return True

    def fold(into: int, root: int) -> None:
        """Add the tree under ``root`` to the automaton at ``into``."""
        stack = [(into, root)]
        while stack:
            x, y = stack.pop()
            p, q = states[x], states[y]
            p.through += q.through
            p.ends += q.ends
            for c, (t, m) in q.to.items():
                s, n = p.to.get(c, (-1, 0))
                p.to[c] = (s if n else t, n + m)
                if n:
                    stack.append((s, t))

    red = [0]
    while True:
        blue = sorted({(t, r, c) for r in red for c, (t, _) in states[r].to.items() if t not in red}, key=lambda x: (-states[x[0]].through, x))
        if not blue:
            break
        new, parent, c = blue[0]
        for r in red:
            if compatible(r, new):
                states[parent].to[c] = (r, states[parent].to[c][1])
                fold(r, new)
                break
        else:
            red.append(new)
    number = {r: k for k, r in enumerate(red)}
    return [_State(states[r].through, states[r].ends, {c: (number[t], n) for c, (t, n) in states[r].to.items()}) for r in red]


def log_likelihood(automaton: list[_State], value: str) -> float:
    """Natural log of the string's probability; unseen steps have half a count and lead back to the start."""
    total, at = 0.0, 0
    for c in value:
        state = automaton[at]
        at, n = state.to.get(c, (0, 0))
        total += math.log((n + 0.5) / (state.through + 0.5 * (SYMBOLS + 1)))
    state = automaton[at]
    return total + math.log((state.ends + 0.5) / (state.through + 0.5 * (SYMBOLS + 1)))


def _pack(automaton: list[_State]) -> list:
    return [[s.through, s.ends, [[c, t, n] for c, (t, n) in sorted(s.to.items())]] for s in automaton]


def _unpack(rows: list) -> list[_State]:
    return [_State(through, ends, {c: (t, n) for c, t, n in to}) for through, ends, to in rows]


def infer_formats(df: DataFrame, text_col: str = "text", examples: int = 1000) -> dict[str, list[_State]]:
    """An automaton per kind of which the texts hold a value, and one for ordinary candidates, under ``other``, if there are enough of them."""
    import json

    def values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = set()
            for text in batch["text"].to_pylist():
                spans = base_spans(text or "")
                found |= {(kind, value) for _, _, kind, value in spans}
                found |= {("other", value) for _, _, value in candidates(text or "", spans)}
            rows = sorted(found)
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([v for _, v in rows], pa.string())], ["kind", "value"])

    labelled = stored(df.select(F.col(text_col).alias("text")).mapInArrow(values, "kind string, value string").distinct(), "credentials")
    sample = None
    for kind in (*KINDS, "other"):
        own = labelled.filter(F.col("kind") == kind).orderBy(F.xxhash64("value"), "value").limit(examples)
        sample = own if sample is None else sample.union(own)

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        if key[0] == "other" and len(rows) < FEW_OTHERS:  # a few candidates would be learned by heart, secrets among them
            return pd.DataFrame({"kind": pd.Series([], dtype=str), "automaton": pd.Series([], dtype=str)})
        return pd.DataFrame({"kind": [key[0]], "automaton": [json.dumps(_pack(infer(sorted(rows["value"]))))]})

    fitted = sample.groupBy("kind").applyInPandas(fit, "kind string, automaton string")
    return {r["kind"]: _unpack(json.loads(r["automaton"])) for r in fitted.collect()}  # four rows, bounded by ``examples``


def format_score(formats: dict[str, list[_State]], value: str) -> float:
    """Log-likelihood per character of the best credential format over that of ordinary candidates (a uniform choice without these)."""
    known = [log_likelihood(a, value) for kind, a in formats.items() if kind != "other"]
    if not known:
        return -math.inf
    plain = log_likelihood(formats["other"], value) if "other" in formats else -len(value) * math.log(SYMBOLS)
    return (max(known) - plain) / (len(value) + 1)


def spans_column(text: Column, formats: dict[str, list[_State]], threshold: float = 0.5) -> Column:
    """All spans by start, then kind: array of ``(kind, start, end, score)`` in code points, end exclusive."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def of(texts: pd.Series) -> pd.Series:
        found = []
        for text in texts:
            base = base_spans(text or "")
            spans = [(kind, start, end, format_score(formats, value)) for start, end, kind, value in base]
            scored = ((start, end, format_score(formats, value)) for start, end, value in candidates(text or "", base))
            spans += [(FORMAT, start, end, score) for start, end, score in scored if score >= threshold]
            order = (*KINDS, FORMAT)
            found.append([dict(zip(("kind", "start", "end", "score"), s)) for s in sorted(spans, key=lambda s: (s[1], order.index(s[0])))])
        release_memory()
        return pd.Series(found, dtype=object)

    return of(text)


def secret_spans(df: DataFrame, text_col: str = "text", examples: int = 1000, threshold: float = 0.5, out: str = "spans") -> DataFrame:
    """``df`` with its secrets as array ``out``; a column of that name is replaced, all others stay.

    A null or empty text has none. Equal rows get equal spans. Without any labelled credential there are no formats and only base spans,
    that is none. An empty table gives no rows.
    """
    formats = infer_formats(df, text_col, examples)
    return df.withColumn(out, spans_column(F.col(text_col), formats, threshold))


def mask(text: Column, spans: Column, by: str = "[SECRET]") -> Column:
    """The text with each run of overlapping spans replaced; a null text stays null."""

    @F.pandas_udf("string")
    def of(texts: pd.Series, found: pd.Series) -> pd.Series:
        made = []
        for text, own in zip(texts, found):
            if text is not None and own is not None and len(own):
                parts, at = [], 0
                for span in own:
                    if span["start"] >= at:
                        parts += [text[at : span["start"]], by]
                    at = max(at, span["end"])
                text = "".join([*parts, text[at:]])
            made.append(text)
        release_memory()
        return pd.Series(made, dtype=object)

    return F.when(F.size(spans) > 0, of(text, spans)).otherwise(text)


def spans_text(spans: Column) -> Column:
    """``kind:start:end``, joined with commas."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
