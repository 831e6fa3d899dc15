"""Personal data by bootstrapped contextual extraction.

Seed entities are what strict patterns find: emails, addresses, cards (Luhn) and phones. The words beside a mention are
its lexical patterns: the word before it, the two before it, and the word behind it. Words that look like an identifier
but are no seed, and runs of digits with blanks, are further mentions. Mentions and patterns make a graph of values and
patterns, which Spark scores in rounds:

- a pattern counts once ``min_known`` different known values stand beside it; it is worth the summed scores of its known
  values over one more than all its identifier-like values;
- a value that is no seed is worth what its best pattern is worth; values worth ``least`` become known and enter the
  next round as seeds do, so they can carry patterns of their own. Rounds go on until nothing new is known.

A pattern must also be specific: of all places where its words stand in the corpus, ``min_share`` must hold an
identifier of its kind, so that common words carry nothing. All mentions of known values become spans; seeds always
stay. A decoy beside a pattern (a number that fails Luhn behind "in") lowers its worth.

One pass over the whole texts finds mentions; one more, only if some pattern may carry a new value, counts how often its
words occur. Both move short rows only, with partial counts before each shuffle. Joins by value or pattern have no
aggregation behind them in the same stage, so the adaptive planner splits what one key fills.

Null text: empty. Each row is a document, repeated rows and null ids too. Offsets are code points, ends exclusive. An
identifier has 320 characters at most, as the longest address has. An empty table gives no rows. Extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from array import array
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewright.llm.common import discard, in_batches, materialize, tasks_for, text_or_empty

KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_WORD = re.compile(r"[^ \t\n\r\f\v]+")
_EDGES = ".,;:!?\"'()[]{}<>|*#$%&"
Span = tuple[int, int, str]


def _emails(text: str) -> Iterator[Span]:
    """Each @ with the local characters before it (after the last match) and a domain behind it."""
    last, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end(), "email"
            last = found.end()
        at = text.find("@", max(at + 1, last))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def seed_spans(text: str) -> list[Span]:
    """All strict matches as (start, end, kind), by start, then in the order of KINDS."""
    out = list(_emails(text))
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), m.end(), "ip") for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p) < 256 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m[0].replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and _luhn(digits):
                    out.append((m.start(), m.end(), "card"))
        if "+" in text:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def possible_kinds(word: str) -> tuple[str, ...]:
    """The kinds that an identifier-like word, or run of digits, may be of, by its shape."""
    digits = sum("0" <= c <= "9" for c in word)
    kinds = []
    if re.search(r"[A-Za-z0-9](?:@|\(at\)|\[at\])[A-Za-z0-9]", word):
        kinds.append("email")
    if digits >= 4 and re.fullmatch(r"[0-9A-Fa-f]{1,4}(?:[.:][0-9A-Fa-f]{0,4}){3,7}", word):
        kinds.append("ip")
    if 12 <= digits <= 19 and re.fullmatch(r"[0-9](?:[-./ ]?[0-9])+", word):
        kinds.append("card")
    if 7 <= digits <= 15 and re.fullmatch(r"\+?[0-9(](?:[-./() ]{0,2}[0-9])+", word):
        kinds.append("phone")
    return tuple(kinds)


def value_of(kind: str, said: str) -> str:
    """What makes two mentions the same identifier."""
    return "".join(c for c in said if "0" <= c <= "9") if kind in ("card", "phone") else said.translate(_LOWER)


_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = {c: chr(c).lower() for c in _UPPER}
#: Words in patterns: A-Z lower-cased, every digit a 0; words over LONG_WORD bytes by their hash.
_SHAPE = bytes.maketrans(_UPPER + b"123456789", _UPPER.lower() + b"0" * 9)
LONG_WORD, MOST_CHARS = 64, 320


def shape(word: bytes) -> bytes:
    """A word (in UTF-8, after _SHAPE) as patterns have it."""
    return word if len(word) <= LONG_WORD else b"#" + xxhash.xxh64_hexdigest(word).encode()


def terms_of(text: str) -> Iterator[bytes]:
    """Every word of a text, and every two in a row, as patterns have them."""
    words = [w if len(w) <= LONG_WORD else shape(w) for w in text.encode().translate(_SHAPE).split()]
    yield from words
    yield from map(b" ".join, itertools.pairwise(words))


class Beside:
    """The patterns of places in a text; its words are found once, 16 bytes each."""

    def __init__(self, text: str) -> None:
        self.text, self.starts, self.ends = text, array("q"), array("q")
        for m in _WORD.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def _said(self, start: int, end: int) -> str:
        return shape(self.text[start:end].encode().translate(_SHAPE)).decode()

    def patterns(self, start: int, end: int) -> list[str]:
        """l: the word before; ll: the two before; r: the word behind. Of a word that the place cuts its part counts, the
        nearest LONG_WORD characters at most, unless it is punctuation only."""
        i, j = bisect_right(self.starts, start) - 1, bisect_right(self.starts, end - 1) - 1
        left = [self._said(self.starts[k], self.ends[k]) for k in range(max(0, i - 2), i)]
        cut = self.text[max(self.starts[i], start - LONG_WORD) : start]
        if cut.strip(_EDGES):
            left.append(self._said(start - len(cut), start))
        cut = self.text[end : min(self.ends[j], end + LONG_WORD)]
        right = self._said(end, end + len(cut)) if cut.strip(_EDGES) else self._said(self.starts[j + 1], self.ends[j + 1]) if j + 1 < len(self.starts) else ""
        before = [f"l {left[-1]}"] if left else []
        return before + ([f"ll {' '.join(left[-2:])}"] if len(left) > 1 else []) + ([f"r {right}"] if right else [])


_LIKE = re.compile(r"[^ \t\n\r\f\v]*(?:[0-9]|@|\(at\)|\[at\])[^ \t\n\r\f\v]*")
_RUN = re.compile(r"(?<![0-9A-Za-z+(.,-])\+?\(?[0-9](?:[-.() ]{0,3}[0-9])+(?![0-9A-Za-z])")


def _likely(text: str) -> Iterator[tuple[int, int]]:
    """Places of words that may be identifiers, and of runs of digits with blanks."""
    for m in _LIKE.finditer(text):
        word = m[0].strip(_EDGES) if m.end() - m.start() <= MOST_CHARS + 40 else ""
        if word and len(word) <= MOST_CHARS:
            start = m.start() + m[0].index(word)
            yield start, start + len(word)
    for m in _RUN.finditer(text):
        if " " in m[0]:
            yield m.span()


def mentions(text: str, seeds: list[Span]) -> Iterator[tuple[str, int, int, str, list[str], bool]]:
    """kind, start, end, value, patterns, seed: the seeds, and what is identifier-like apart from them."""
    open_ = bool(_DIGIT.search(text)) or "@" in text or "(at)" in text or "[at]" in text
    if not seeds and not open_:
        return
    beside = None
    taken = sorted((a, b) for a, b, _ in seeds)
    firsts = [a for a, _ in taken]
    reach = list(itertools.accumulate((b for _, b in taken), max))
    given = [(kind, start, end, True) for start, end, kind in seeds]
    for start, end in sorted(set(_likely(text))) if open_ else ():
        at = bisect_left(firsts, end)
        if not at or reach[at - 1] <= start:
            given += [(kind, start, end, False) for kind in possible_kinds(text[start:end])]
    for kind, start, end, seed in given:
        beside = beside or Beside(text)
        yield kind, start, end, value_of(kind, text[start:end]), beside.patterns(start, end), seed


_FOUND = (
    "doc_id long, row_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, "
    "mentions array<struct<kind:string,start:int,end:int,value:string,patterns:array<string>,seed:boolean>>"
)
_MENTION = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string()), ("patterns", pa.list_(pa.string())), ("seed", pa.bool_())])


def scan(docs: DataFrame) -> DataFrame:
    """A row per document: counts, digest and list of its seed spans, and its mentions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                counts, digests, spans, found = [], [], [], []
                for text in b["text"].to_pylist():
                    seeds = seed_spans(text)
                    said = ",".join(f"{k}:{s}:{e}" for s, e, k in seeds)
                    counts.append([sum(x[2] == k for x in seeds) for k in KINDS])
                    digests.append(hashlib.sha256(said.encode()).hexdigest())
                    spans.append(said)
                    found.append([dict(zip(_MENTION.names, m, strict=True)) for m in mentions(text, seeds)])
                columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(4)]
                columns = [b["doc_id"], b["row_id"], *columns, pa.array(digests), pa.array(spans), pa.array(found, pa.list_(_MENTION))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "mentions"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row_id"), text_or_empty("text").alias("text"))
    return materialize(in_batches(texts, run, _FOUND), "scanned")


def _graph(docs: DataFrame, found: DataFrame, min_known: int, min_share: float) -> DataFrame | None:
    """kind, value, pattern, seed: the edges to specific patterns that may come to carry a value; None without any.

    A pattern with fewer than ``min_known`` values can never carry one, nor can one that has seeds only.
    """
    edges = found.select("kind", "value", "seed", F.explode("patterns").alias("pattern")).groupBy("kind", "pattern", "value").agg(F.count(F.lit(1)).alias("n"), F.max("seed").alias("seed"))
    edges = materialize(edges, "edges", tasks_for(found))
    usable = edges.groupBy("kind", "pattern").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("values"), F.count_if("seed").alias("seeds"))
    usable = materialize(usable.where((F.col("values") > min_known) & (F.col("values") > F.col("seeds"))), "usable", tasks_for(edges))
    graph = None
    if not usable.isEmpty():
        term = F.expr("substr(pattern, instr(pattern, ' ') + 1)")
        occurs = _occurrences(docs, usable.select(term.alias("term")).distinct())
        known = usable.withColumn("term", term).join(occurs, "term", "left")
        specific = known.where(F.col("n") >= F.greatest("n", F.coalesce("occurs", "n")) * min_share).select("kind", "pattern")
        graph = materialize(edges.join(specific, ["kind", "pattern"], "left_semi").select("kind", "value", "pattern", "seed"), "graph", tasks_for(edges))
    discard(edges, usable)
    return graph


def _occurrences(docs: DataFrame, asked: DataFrame, most_broadcast: int = 200_000) -> DataFrame:
    """term, occurs: how often each asked word or two words in a row occur in the whole texts.

    Up to ``most_broadcast`` terms (20 MB) go to the tasks, which then count these alone; with more, all terms are counted
    and joined.
    """
    asked = materialize(asked, "asked", tasks_for(asked))
    few = asked.count() <= most_broadcast
    sent = docs.sparkSession.sparkContext.broadcast(frozenset(r.term.encode() for r in asked.collect()) if few else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = sent.value
        for b in batches:
            found: Counter[bytes] = Counter()
            for text in b["text"].to_pylist():
                found.update(terms_of(text) if wanted is None else filter(wanted.__contains__, terms_of(text)))
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()).cast(pa.string()), pa.array(list(found.values()), pa.int64())], names=["term", "n"])

    terms = in_batches(docs.select(text_or_empty("text").alias("text")), count, "term string, n long")
    return terms.join(asked, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("occurs"))


def discovered(docs: DataFrame, found: DataFrame, min_known: int = 3, least: float = 0.6, min_share: float = 0.2, most_rounds: int = 20, hide: Column | None = None) -> DataFrame | None:
    """kind, value, score, round of the values that patterns carry; None if there are none.

    ``hide`` (of kind and value): seeds that are to be treated as unknown, to measure how many come back.
    """
    if hide is not None:
        found = found.withColumn("seed", F.col("seed") & ~hide)
    graph = _graph(docs, found, min_known, min_share)
    if graph is None:
        return None
    new, before = None, 0
    for round_ in range(1, most_rounds + 1):
        scored = graph if new is None else graph.join(new.select("kind", "value", "score", "round"), ["kind", "value"], "left")
        score = F.when(F.col("seed"), 1.0) if new is None else F.when(F.col("seed"), 1.0).otherwise(F.col("score"))
        first = F.lit(None).cast("int") if new is None else F.col("round")
        scored = scored.select("kind", "value", "pattern", "seed", score.alias("score"), first.alias("round"))
        worth = scored.groupBy("kind", "pattern").agg((F.sum("score") / (F.count(F.lit(1)) + 1)).alias("worth"), F.count("score").alias("known"))
        carried = scored.where("NOT seed").join(worth.where((F.col("known") >= min_known) & (F.col("worth") >= least)), ["kind", "pattern"])
        now = carried.groupBy("kind", "value").agg(F.max("worth").alias("score"), F.coalesce(F.min("round"), F.lit(round_)).alias("round"))
        if new is not None:  # what is known stays known
            old = new.select("kind", "value", F.col("score").alias("was"), F.col("round").alias("since"))
            now = now.join(old, ["kind", "value"], "full").select("kind", "value", F.greatest("score", "was").alias("score"), F.coalesce("since", "round").alias("round"))
        now = materialize(now, "known", tasks_for(graph))
        if new is not None:
            discard(new)
        new, count = now, now.count()
        if count == before:
            break
        before = count
    discard(graph)
    return new if before else None


def masked_recall(docs: DataFrame, parts: int = 4, **how) -> tuple[int, int]:
    """How many seed values stand beside the hidden ones (one of ``parts`` is hidden by its hash), and how many of those
    come back through patterns."""
    found = scan(docs).select(F.inline("mentions"))
    hide = F.pmod(F.xxhash64(F.lit(17), "kind", "value"), F.lit(parts)) == 0
    hidden = found.where(F.col("seed") & hide).select("kind", "value").distinct()
    back = discovered(docs, found, hide=hide, **how)
    return hidden.count(), 0 if back is None else hidden.join(back, ["kind", "value"], "left_semi").count()


def find_pii(docs: DataFrame, **how) -> DataFrame:
    """A row per document: doc_id, counts and digest of the seed spans, spans, which holds those of discovered values too,
    and n_discovered, the number of the latter. ``how``: as for :func:`discovered`."""
    scanned = scan(docs)
    columns = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256"]
    found = scanned.select("row_id", F.inline("mentions"))
    new = discovered(docs, found, **how)
    if new is None:
        return scanned.select(*columns, "spans", F.lit(0).cast("long").alias("n_discovered"))
    rank = F.expr("array_position(array('email', 'ip', 'card', 'phone'), kind)").alias("rank")
    fresh = found.where("NOT seed").join(new.select("kind", "value"), ["kind", "value"]).select("row_id", F.struct("start", rank, "kind", "end").alias("span")).distinct()
    more = fresh.groupBy("row_id").agg(F.collect_list("span").alias("more"))
    seeds = F.transform(
        F.filter("mentions", lambda m: m["seed"]),
        lambda m: F.struct(m["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), m["kind"]).alias("rank"), m["kind"].alias("kind"), m["end"].alias("end")),
    )
    every = F.sort_array(F.concat(seeds, "more"))
    said = F.array_join(F.transform(every, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return scanned.join(more, "row_id", "left").select(*columns, F.when(F.col("more").isNull(), F.col("spans")).otherwise(said).alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_discovered"))
