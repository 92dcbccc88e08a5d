"""Secret scans through a trigram inverted index.

Each rule's regular expression is turned into a Boolean query over trigrams that any match must hold (parsed with Python's
own regex parser; ASCII case is folded on both sides, so one index serves all rules). Each Arrow batch of documents gets an
inverted index of the trigrams that some query names: trigram -> rows. A rule's query, evaluated on the postings by
intersection and union, gives candidate rows; only these are scanned with the regex. A rule without mandatory trigrams
scans every row. The index is a segment per batch, built and used where the rows are, so nothing is shuffled and every
row is indexed.

Base rules: assign, access and hex (their match must also be long enough). The further rules add spans of known key
formats. Matches of a rule are leftmost and do not overlap; spans count code points, the end is exclusive.

Edge cases: null and empty texts have no spans. Very long texts are scanned whole, one at a time, in time linear in their
length. Repeated rows and null ids are scanned like others. Only the id and text columns are read, so others may have any name
(redact_documents keeps them). An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StructType

from .common import documents, in_slices, small_batches, whole_row

#: A query is True (no demand), a trigram, ("and", ...) or ("or", ...).
Query = object
_MANY = 16  # sets of exact strings stay this small


@dataclass
class Rule:
    kind: str
    pattern: str
    ignore_case: bool = False
    keep: Callable[[re.Match], bool] = lambda m: True
    compiled: re.Pattern = field(init=False)
    query: Query = field(init=False)

    def __post_init__(self):
        self.compiled = re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.ignore_case else 0))
        self.query = trigram_query(self.pattern)

    def spans(self, text: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(text) if self.keep(m)]


def _longer_than(n: int, group: int = 0) -> Callable[[re.Match], bool]:
    return lambda m: len(m[group]) >= n


def _both(kind: str, parts: list) -> Query:
    """and/or of queries, simplified."""
    flat = []
    for p in parts:
        flat += p[1:] if isinstance(p, tuple) and p[0] == kind else [p]
    if kind == "or" and (not flat or any(p is True for p in flat)):
        return True
    flat = list(dict.fromkeys(p for p in flat if p is not True))
    return True if not flat else flat[0] if len(flat) == 1 else (kind, *flat)


def _demand(strings: set[str]) -> Query:
    """Any of the strings occurs: each demands all of its trigrams; one shorter than three letters demands nothing."""
    return _both("or", [_both("and", [s[i : i + 3] for i in range(len(s) - 2)]) for s in sorted(strings)])


def _walk(items) -> tuple[list[Query], set[str] | None]:
    """Demands of a sequence, and all strings it can match if these are few."""
    demands: list[Query] = []
    run: set[str] | None = {""}  # what the current run of few choices can be
    few = True

    def close() -> None:
        nonlocal run
        demands.append(_demand(run))
        run = {""}

    for code, arg in items:
        sub: set[str] | None = None
        if code is op.LITERAL:
            sub = {chr(arg).lower()}
        elif code is op.IN and all(c is op.LITERAL for c, _ in arg):
            sub = {chr(a).lower() for _, a in arg}
        elif code is op.SUBPATTERN:
            inner, sub = _walk(arg[3])
            demands += inner if sub is None else []
        elif code is op.BRANCH:
            each = [_walk(x) for x in arg[1]]
            if all(s is not None for _, s in each):
                sub = set().union(*(s for _, s in each))
            else:
                demands.append(_both("or", [_both("and", d if s is None else [*d, _demand(s)]) for d, s in each]))
        elif code in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, inner = arg
            d, s = _walk(inner)
            if s is not None and high <= 2 and low == high:
                sub = {""}
                for _ in range(low):
                    sub = {a + b for a in sub for b in s}
            elif s is not None and low == 0 and high == 1:
                sub = s | {""}
            elif low:
                demands += d if s is None else [_demand(s)]
        elif code is op.AT:
            continue
        if sub is None or len(sub) > _MANY:
            close()
            few = False
        else:
            longer = {a + b for a in run for b in sub}
            if len(longer) > 4 * _MANY:
                close()
                few, run = False, sub
            else:
                run = longer
    if few:
        return demands, run
    close()
    return demands, None


def trigram_query(pattern: str) -> Query:
    """What any match's lower-cased text must hold."""
    demands, exact = _walk(parser.parse(pattern))
    return _both("and", [*demands, _demand(exact)] if exact is not None else demands)


def trigrams_of(query: Query) -> set[str]:
    if isinstance(query, str):
        return {query}
    return set().union(*(trigrams_of(q) for q in query[1:])) if isinstance(query, tuple) else set()


# The base rules, then public key formats. No two starts of a rule share the run that they read, so that time is
# linear in the text: a token's rule starts where its run of letters does.
BASE = [
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", True, _longer_than(12, 2)),
    Rule("access", r"AKIA[A-Z0-9]+", False, _longer_than(18)),
    Rule("hex", r"[0-9a-f]{16,}"),  # the maximal runs of 16 and more, as [0-9a-f]+ with the short ones dropped
]
MORE = [
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("basic", r"https?://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+-]{8,}@"),
]
RULES = BASE + MORE


class Index:
    """Trigrams of interest -> sorted rows, of a list of UTF-8 texts."""

    def __init__(self, trigrams: set[str]):
        self.numbers = {t: i for i, t in enumerate(sorted(t for t in trigrams if t.isascii()), 1)}
        self.table = np.zeros(1 << 24, np.uint16)
        for t, i in self.numbers.items():
            a, b, c = t.encode()
            self.table[a << 16 | b << 8 | c] = i
        self.fold = np.arange(256, dtype=np.uint8)
        self.fold[65:91] += 32

    def postings(self, texts: list[bytes]) -> dict[str, set[int]]:
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
        data = self.fold[np.frombuffer(b"\0".join(texts) + b"\0\0\0", np.uint8)].astype(np.uint32)
        code = self.table[(data[:-2] << 16) | (data[1:-1] << 8) | data[2:]]
        at = np.flatnonzero(code)
        rows, codes = np.searchsorted(offsets, at, "right") - 1, code[at]
        return {t: set(rows[codes == i].tolist()) for t, i in self.numbers.items()}


def candidates(query: Query, postings: dict[str, set[int]], rows: int) -> set[int]:
    """Rows that may match; a trigram outside ASCII isn't indexed and demands nothing."""
    if isinstance(query, str):
        return postings[query] if query in postings else set(range(rows))
    if not isinstance(query, tuple):
        return set(range(rows))
    parts = [candidates(q, postings, rows) for q in query[1:]]
    return set.intersection(*parts) if query[0] == "and" else set.union(*parts)


def scan(texts: list[str], index: Index, rules: list[Rule]) -> list[list[tuple[int, int, int, str]]]:
    """For each text its spans (start, number of the rule, end, kind), in the order of start and rule."""
    found: list[list[tuple[int, int, int, str]]] = [[] for _ in texts]
    postings = index.postings([t.encode() for t in texts])
    for number, rule in enumerate(rules):
        for i in candidates(rule.query, postings, len(texts)):
            found[i] += [(a, number, b, rule.kind) for a, b in rule.spans(texts[i])]
    return [sorted(f) for f in found]


def _in_slices(texts: list[str], most: int = 1 << 21) -> Iterator[list[str]]:
    """Bounded parts of a batch, so that an index segment stays small."""
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > most:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def scan_batches(batches: Iterator[pa.RecordBatch], text_col: str, rules: list[Rule]) -> Iterator[tuple[pa.RecordBatch, list[str], list]]:
    index = Index(set().union(*(trigrams_of(r.query) for r in rules)))
    for b in in_slices(batches):
        texts = [t or "" for t in b.column(text_col).to_pylist()]
        yield b, texts, [f for part in _in_slices(texts) for f in scan(part, index, rules)]


def joined(spans: list[tuple[int, int, int, str]]) -> str:
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None) -> DataFrame:
    """id and spans (array of kind, start, end) of every row."""
    rules = rules or RULES
    schema = docs.select(id_col).schema.add("spans", ArrayType(StructType().add("kind", "string").add("start", "long").add("end", "long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for b, _, found in scan_batches(batches, text_col, rules):
            yield pa.record_batch([b.column(0), pa.array([[{"kind": k, "start": a, "end": e} for a, _, e, k in f] for f in found], kind)], names=[id_col, "spans"])

    return small_batches(docs).select(id_col, text_col).mapInArrow(run, schema)


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    schema = docs.select("doc_id").schema.add("n_assign", "long").add("n_access", "long").add("n_hex", "long").add("base_sha256", "string").add("spans", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, _, found in scan_batches(batches, "text", RULES):
            base = [[s for s in f if s[1] < len(BASE)] for f in found]
            counts = [pa.array([sum(s[1] == i for s in f) for f in base], pa.int64()) for i in range(len(BASE))]
            shas = [hashlib.sha256(joined(f).encode()).hexdigest() for f in base]
            yield pa.record_batch([b.column(0), *counts, pa.array(shas, pa.string()), pa.array([joined(f) for f in found], pa.string())], names=schema.names)

    return small_batches(docs).mapInArrow(run, schema)


def redact(text: str, spans: list[tuple[int, int, int, str]], mark: str = "<{}>") -> str:
    """The text with every span, overlapping ones together, replaced by its first kind."""
    out, at = [], 0
    for a, _, b, kind in spans:
        if a >= at:
            out += [text[at:a], mark.format(kind)]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with every secret replaced by its kind; no row is dropped. Of a changed text n_chars, if it is a number, is counted
    anew. Only the text goes to Python, so columns of any name and type stay; null and empty texts stay as they are."""

    @F.arrow_udf("string")
    def redacted(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            out = []
            for _, known, found in scan_batches(iter([pa.record_batch([t], names=["text"])]), "text", RULES):
                out += [redact(x, f) if f else None for x, f in zip(known, found, strict=True)]
            yield pa.array(out, pa.string())  # null: nothing was found

    made = small_batches(docs).select(whole_row(docs).alias("row"), redacted("text").alias("new"))
    fields = {c: F.col("row")[c] for c in docs.columns}
    fields["text"] = F.coalesce("new", fields["text"])
    if "n_chars" in fields and isinstance(kind := docs.schema["n_chars"].dataType, NumericType):
        fields["n_chars"] = F.when(F.col("new").isNotNull(), F.length("new").cast(kind)).otherwise(fields["n_chars"])
    return made.select(*(c.alias(name) for name, c in fields.items()))
