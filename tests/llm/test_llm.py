"""The ten operators against brute force, exact round trips and held-out accuracy, with nulls, ties and odd rows."""

from __future__ import annotations

import hashlib
import itertools
import json
import math
import pathlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lanewright.llm import bpe, chat, decontam, linededup, media, neardup, pii, quality, queries, sharding, urlfilter
from lanewright.llm.common import KeyBitmap, materialize
from lanewright.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, *texts, source="s"):
    rows = [(i, t, "en", source, len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def words(rng, n):
    return " ".join(f"{rng.choice('bcdfgklmnprstvz')}{rng.choice('aeiou')}{rng.randrange(40)}" for _ in range(n))


# 1


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="\\#</turn>: ab\n", max_size=40), st.text(alphabet="\\#: ua<\n", max_size=8))
def test_chat_round_trip(text, role):
    rendered, start, end, _ = chat.format_turn(role, text)
    assert [t[:2] for t in chat.parse(rendered + rendered)] == [(role, text)] * 2
    assert re.sub(r"(?s)\\(.)", r"\1", rendered[start:end]) == text


CONTROL_PIECES = ["###", "### ", "#", " ", "</turn>", " </turn>", " </turn>\n", "</turn", "\\", "\n", ": ", ":", "user", "a", "é"]


@settings(max_examples=600, deadline=None)
@given(st.lists(st.sampled_from(CONTROL_PIECES), max_size=40).map("".join), st.lists(st.sampled_from(CONTROL_PIECES), max_size=6).map("".join))
def test_chat_round_trip_of_control_strings(text, role):
    """Prefixes and suffixes of the grammar's own strings, at both ends of a text too."""
    for body in (text, text + "###", "x ###", "###", "</turn> ###", " </turn>"):
        rendered, start, end, step = chat.format_turn(role, body)
        assert [t[:2] for t in chat.parse(rendered + rendered)] == [(role, body)] * 2
        assert re.sub(r"(?s)\\(.)", r"\1", rendered[start:end]) == body
        more = body.count("\\") + body.count("### ") + body.endswith("###") + body.count("</turn>")
        assert end - start == len(body) + more and step == (2 if "\\" in body else 1 if more else 0)


def same_rows(spark, path, name):
    """Whether a query and its SQL give the same rows over the tables in a folder."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in sorted(pathlib.Path(path).glob("*.parquet")):
        con.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM read_parquet('{f}/*.parquet')" if f.is_dir() else f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    df = queries.QUERIES[name](spark, str(path))
    got = Counter(repr(tuple(r[c] for c in sorted(df.columns))) for r in df.collect())
    table = con.execute(queries.ORACLE_SQL[name])
    order = sorted(range(len(table.description)), key=lambda i: table.description[i][0])
    want = Counter(repr(tuple(r[i] for i in order)) for r in table.fetchall())
    assert sorted(df.columns) == [table.description[i][0] for i in order]
    return got == want


def test_chat_query_and_its_sql(spark, tmp_path):
    rng = random.Random(31)
    texts = ["x ###", "###", "</turn> ###", "### ", "#### ", "\\", "a\\### b", None, "", "ok </turn>\n", "### ###", "é" * 30000 + "###"]
    texts += ["".join(rng.choice(CONTROL_PIECES) for _ in range(rng.randrange(40))) for _ in range(300)]
    rows = [(i // 5, i % 5, rng.choice(["user", "assistant", "system"]), t, "x") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, rendered string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert same_rows(spark, tmp_path, "op1_chat_formatting")


def test_chat_conversations(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", None), (1, 1, "assistant", "b"), (2, None, None, "### x </turn>"), (None, 0, "user", "\\")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, rendered string")
    found = {r.conv_id: r for r in chat.digest_conversations(chat.format_conversations(df)).collect()}
    assert {k: r.n_turns for k, r in found.items()} == {1: 3, 2: 1, None: 1}
    assert found[1].turns_sha256 == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest() and found[1].loss_chars == 2
    assert chat.digest_conversations(chat.format_conversations(df.limit(0))).count() == 0
    with pytest.raises(chat.GrammarError):
        list(chat.parse("### user: no end"))


# 2


def strict_spans(text):
    out = []
    for rank, (kind, p) in enumerate((("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"))):
        for m in re.finditer(p, text):
            d = re.sub("[^0-9]", "", m[0])
            luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(d[::-1])) % 10 == 0
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else 0, "card": 14 <= len(d) <= 19 and luhn, "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), rank, m.end(), kind))
    return [(a, b, k) for a, _, b, k in sorted(out)]


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="a.@-+_ 0123459()é", max_size=60))
def test_pii_base_spans(text):
    assert pii.seed_spans(text) == strict_spans(text)


def brute_discovered(texts, min_known=3, least=0.6, min_share=0.2):
    """The bootstrap with plain dictionaries."""
    low = lambda t: re.sub("[1-9]", "0", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    edges, seeds, n, occurs = {}, set(), Counter(), Counter()
    for t in map(lambda t: t or "", texts):
        words = low(t).split()
        occurs.update(words + [" ".join(p) for p in itertools.pairwise(words)])
        for kind, _, _, value, patterns, seed in pii.mentions(t, pii.seed_spans(t)):
            seeds |= {(kind, value)} if seed else set()
            for p in patterns:
                edges.setdefault((kind, p), set()).add((kind, value))
                n[kind, p] += 1
    edges = {p: v for p, v in edges.items() if n[p] >= min_share * max(n[p], occurs[p[1].split(" ", 1)[1]])}
    score, since = dict.fromkeys(seeds, 1.0), {}
    for round_ in range(1, 99):
        worth = {p: sum(score.get(x, 0) for x in v) / (len(v) + 1) for p, v in edges.items() if sum(x in score for x in v) >= min_known}
        now = {}
        for p, w in worth.items():
            for x in edges[p] - seeds:
                if w >= least:
                    now[x] = max(w, now.get(x, 0), score.get(x, 0))
        since |= {x: round_ for x in now if x not in since}
        if all(x in score for x in now):
            return since
        score |= now


def pii_corpus():
    """Phones behind a cue; addresses spelled out, first beside a cue that phones and addresses share, then beside cues of their own."""
    rng = random.Random(41)
    words = lambda rng, n: " ".join("".join(rng.choice("bdfglmnrst") + rng.choice("aeiou") for _ in range(3)) for _ in range(n))
    phone = lambda: f"{rng.randrange(200, 999)}-{rng.randrange(200, 999)}-{rng.randrange(1000, 9999)}"
    name = lambda: words(rng, 1)
    out = [f"{words(rng, 5)} dial +1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)} {words(rng, 3)}" for _ in range(80)]
    shared = [phone() for _ in range(12)]
    out += [f"{words(rng, 4)} dial {x} {words(rng, 3)}" for x in shared]  # round 1: behind the cue of the seeds
    out += [f"{words(rng, 4)} reach me {x} anytime {words(rng, 3)}" for x in shared]  # which are known elsewhere too
    out += [f"{words(rng, 4)} reach me {phone().replace('-', ' ')} anytime {words(rng, 3)}" for _ in range(2)]  # round 2
    out += [f"{words(rng, 4)} mailbox {name()}@m{i}.example.com {words(rng, 3)}" for i in range(40)]
    out += [f"{words(rng, 4)} mailbox {name()}(at)m{i}.example.com {words(rng, 3)}" for i in range(3)]
    decoys = [f"{words(rng, 4)} part {phone()} {words(rng, 3)}" for _ in range(20)]
    decoys += [f"{words(rng, 4)} the {rng.randrange(10**15, 10**16)} {words(rng, 3)} the {words(rng, 1)} the {words(rng, 1)}" for _ in range(20)]
    return out, decoys


def test_pii_bootstrap_by_brute_force(spark):
    found, decoys = pii_corpus()
    texts = [*found, *decoys, None, "", found[0], "x" * 500 + " dial 212-555-0000"]
    d = docs(spark, *texts)
    got = {(r.kind, r["value"]): r["round"] for r in pii.discovered(d, pii.scan(d).select(F.inline("mentions"))).collect()}
    assert got == brute_discovered(texts)
    assert Counter(got.values()) == {1: 12 + 3 + 1, 2: 2}  # behind the seeds' cues, then behind cues that only found ones carry
    rows = {r.doc_id: r for r in pii.find_pii(d).collect()}
    assert len(rows) == len(texts) and all(rows[i].spans for i in range(len(found))) and not any(rows[i].n_discovered for i in range(len(found), len(found) + len(decoys) + 2))
    assert [sum(r.n_discovered for r in rows.values()), rows[len(texts) - 1].spans] == [12 + 12 + 2 + 3 + 1, "phone:506:518"]
    for i, t in enumerate(texts):
        base = strict_spans(t or "")
        assert set(",".join(f"{k}:{a}:{b}" for a, b, k in base).split(",")) <= {*rows[i].spans.split(","), ""}
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in base).encode()).hexdigest()


def test_pii_hidden_seeds_come_back(spark):
    found, decoys = pii_corpus()
    hidden, back = pii.masked_recall(docs(spark, *found, *decoys))
    assert hidden >= 8 and back >= 0.9 * hidden


def test_pii_edges(spark):
    assert pii.find_pii(docs(spark, "a").limit(0)).count() == 0
    assert [r.spans for r in pii.find_pii(docs(spark, "a@b.cd", "4111111111111111")).orderBy("doc_id").collect()] == ["email:0:6", "card:0:16"]
    d = docs(spark, "reach a@b.cd now", None).withColumn("spans", F.lit(1)).withColumn("row_id", F.lit(1))
    assert [(r.spans, r.n_discovered) for r in pii.find_pii(d).orderBy("doc_id").collect()] == [("email:6:12", 0), ("", 0)]
    long = "1" * 200_000 + "x " + "a-b@" * 50_000 + " 1 2 " * 50_000
    assert len(list(pii.mentions(long, pii.seed_spans(long)))) < 10
    assert pii.Beside("see (a@b.cd), Tel9").patterns(5, 11) == ["l see", "r tel0"]
    assert pii.Beside("a@b.cd").patterns(0, 6) == [] and pii.Beside(" 1.2.3.4 x").patterns(1, 8) == ["r x"]
    assert pii.Beside("mail:a@b.cd").patterns(5, 11) == ["l mail:"]


# 3


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(texts)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(texts))], [len(s) for s in sets]


def near_texts():
    rng = random.Random(4)
    out = [None, "", "  ", "One", "one", "two words", "two  WORDS"]
    for _ in range(6):
        base = words(rng, 90).split()
        for edits in (0, 0, 1, 2, 3, 4, 5, 6, 8, 12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = "edit" + str(rng.randrange(99))
            out.append(" ".join(w))
    return out


@pytest.mark.parametrize("small_blocks", [False, True])
def test_near_duplicates(spark, small_blocks):
    texts = near_texts()
    p = neardup.NearDup(words=3, percent=85, **({"block_rows": 4} if small_blocks else {}))
    found = {r.doc_id: r for r in neardup.near_duplicates(docs(spark, *texts), p).collect()}
    want, sizes = brute_components(texts, 3, 85)
    assert [found[i].component_id for i in range(len(texts))] == want
    assert [found[i].n_shingles for i in range(len(texts))] == sizes
    assert all(found[i].kept == (want[i] == i) for i in range(len(texts)))


def test_odd_sketches_tell_similarity():
    p = neardup.NearDup(words=3, percent=85)
    signer, rng = neardup.Signer(p), np.random.default_rng(1)
    for s in (0.85, 0.95):
        for _ in range(20):
            n = 400
            both = rng.integers(0, 1 << 63, int(n * 2 * s / (1 + s)), dtype=np.uint64)
            a, b = (np.unique(np.concatenate([both, rng.integers(0, 1 << 63, n - len(both), dtype=np.uint64)])) for _ in range(2))
            sketch = signer.sketches(np.stack([signer.sign(a), signer.sign(b)]))
            assert np.bitwise_count(sketch[0] ^ sketch[1]).sum() <= p.most_bits


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(30)] + [(50, 49), (50, 50), (None, 3), (7, 3)], "a long, b long")
    found = dict(components(links).collect())
    assert all(found[i] == 0 for i in range(31)) and found[50] == found[49] == 49
    assert components(links.limit(0)).count() == 0


# 4


def allowed(width):
    """Every set of words of a window that may be substituted."""
    most = width - math.ceil(width * 0.8)
    return [set(c) for k in range(most + 1) for c in itertools.combinations(range(width), k)]


def test_masks_lose_nothing():
    """Every item length, window of the item, place in the text and allowed substitution leaves a seed whole."""
    for n in range(1, 21):
        width = min(13, n)
        for first, phase in itertools.product(range(n - width + 1), range(decontam.STRIDE)):
            if n < 13:  # a text has its seeds at every place
                seeds = [{at + i for i in m} for m, at in decontam.short_seeds(n)]
            else:  # the item has its seeds at every place, the text at every third; windows count from the item's start
                seeds = [{at + i for i in m} for m in decontam.MASKS for at in range(n - m[-1]) if (at + phase) % decontam.STRIDE == 0]
            within = [s for s in seeds if min(s) >= first and max(s) < first + width]
            assert all(any(not {first + x for x in subs} & s for s in within) for subs in allowed(width)), (n, first, phase)


def brute_overlaps(texts, items):
    split = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    out = {}
    for i, item in items.items():
        asked = split(item)
        width = min(13, len(asked))
        for d, text in enumerate(texts):
            said, best, windows = split(text), 0, 0
            for shift in range(-len(asked), len(said)) if asked else ():
                equal = [0 <= k + shift < len(said) and said[k + shift] == w for k, w in enumerate(asked)]
                good = sum(0 <= k + shift and k + shift + width <= len(said) and sum(equal[k : k + width]) * 100 >= width * 80 for k in range(len(asked) - width + 1))
                if good:
                    best, windows = max(best, sum(equal)), windows + good
            if windows:
                out[d, i] = (len(asked), best, windows)
    return out


def test_overlaps_by_brute_force(spark, tmp_path):
    """Items of 1 to 20 words, substituted as far as allowed and one word further, at every phase; and the query's SQL."""
    rng = random.Random(21)
    items = {n: words(rng, n) for n in range(1, 21)} | {30: words(rng, 60), 31: "Alone", 32: ""}
    texts = [None, "", words(rng, 300), " ".join(items.values()) + " " + items[20]]
    for n, item in items.items():
        for phase, subs in itertools.product(range(3), rng.sample(allowed(min(13, n)), min(6, len(allowed(min(13, n))))) if n < 21 else [set(), {5, 30}]):
            said = ["changed" if i in subs else w for i, w in enumerate(item.split())]
            for more in (said, [*said[:-1], "other"]):
                texts.append(" , ".join(["before"] * phase + more + ["behind"] * rng.randrange(15)))
    want = brute_overlaps(texts, items)
    d, bench = docs(spark, *texts), spark.createDataFrame(list(items.items()), "item_id long, text string")
    for most in (1_000_000, 0):
        found = {(r.doc_id, r.item_id): (r.item_words, r.matched, r.windows) for r in decontam.overlaps(d, bench, most_broadcast=most).collect()}
        assert found == want
    d.withColumn("key", F.lit(1)).withColumn("_key", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    assert same_rows(spark, tmp_path, "op4_decontamination")
    clean = decontam.decontaminate(spark.read.parquet(f"{tmp_path}/documents.parquet"), bench)
    assert {"key", "_key"} <= set(clean.columns) and {r.doc_id for r in clean.collect()} == set(range(len(texts))) - {x for x, _ in want}


def test_decontamination(spark):
    rng = random.Random(2)
    item = words(rng, 20).split()
    swap = [w if i not in (3, 9, 15) else "changed" for i, w in enumerate(item)]
    texts = [words(rng, 50) + " " + " ".join(item) + " " + words(rng, 9), " ".join(item).upper(), words(rng, 9) + " | " + " , ".join(swap), words(rng, 400), None, "", " ".join(item[:9]), " ".join(item)]
    bench = spark.createDataFrame([(1, " ".join(item)), (1, " ".join(item)), (2, "capital of france"), (3, None)], "item_id long, text string")
    d = docs(spark, *texts, "The capital of FRANCE, is")
    found = {r.doc_id: (r.item_id, r.matched) for r in decontam.overlaps(d, bench).collect()}
    assert found == {0: (1, 20), 1: (1, 20), 2: (1, 17), 7: (1, 20), 8: (2, 3)}
    assert found == {r.doc_id: (r.item_id, r.matched) for r in decontam.overlaps(d, bench, most_broadcast=0).collect()}
    assert sorted(r.doc_id for r in decontam.decontaminate(d, bench).collect()) == [3, 4, 5, 6]
    assert decontam.overlaps(d, bench.limit(0)).count() == 0 == decontam.overlaps(d.limit(0), bench).count()
    assert decontam.overlaps(d.unionByName(d), bench).count() == len(found)


def test_items_without_id_count(spark):
    rng = random.Random(22)
    one, two, three = (words(rng, n) for n in (20, 15, 9))
    bench = spark.createDataFrame([(None, one), (None, two), (4, two), (4, three)], "item_id long, text string")
    d = docs(spark, words(rng, 9) + " " + one, two, three, words(rng, 60))
    for most in (1_000_000, 0):
        found = {(r.doc_id, r.item_id): (r.item_words, r.matched, r.windows) for r in decontam.overlaps(d, bench, most_broadcast=most).collect()}
        assert found == {(0, None): (20, 20, 8), (1, None): (15, 15, 3), (1, 4): (15, 15, 3), (2, 4): (9, 9, 1)}
    assert [r.doc_id for r in decontam.decontaminate(d, bench).collect()] == [3]


# 5


def brute_lines(rows, ratio):
    """doc_id, source, text, n_lines, n_dropped of each (doc_id, source, text), with plain dictionaries."""
    on, total = Counter(), Counter()
    for _, source, text in rows:
        total[source] += 1
        on.update({(source, line.strip(" ")) for line in (text or "").split("\n")})
    out = []
    for i, source, text in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for x in lines if not x.strip(" ") or on[source, x.strip(" ")] - 1 <= ratio * total[source]]
        out.append((i, len(lines) - len(kept), len(lines), source, "\n".join(kept) if text is not None else None))
    return Counter(map(repr, out))


def test_line_dedup_by_brute_force(spark, tmp_path):
    rng = random.Random(51)
    common = [words(rng, 4) for _ in range(6)]
    rows = []
    for source, n in (("big", 120), ("small", 2), ("four", 4), (None, 30), ("one", 1)):
        for i in range(n):
            body = [words(rng, 5), " " + common[0] + " "] + [c for c in common[1:] if rng.random() < 0.06] + [""]
            rows.append((len(rows), source, rng.choice([None, "", "\n"]) if rng.random() < 0.05 else "\n".join(body)))
    rows += [(7, "big", rows[7][2]), (None, "big", "x" * 100000 + "\n" + common[0])]
    table = spark.createDataFrame([(i, s, t, 1, 2, 3, 4) for i, s, t in rows], "doc_id long, source string, text string, _bad int, _host int, _lines int, total int")
    for ratio in (0.05, 0.3):
        found = linededup.drop_boilerplate(table, ratio=ratio).collect()
        got = Counter(repr((r.doc_id, r.n_dropped, r.n_lines, r.source, r.text)) for r in found)
        assert got == brute_lines(rows, ratio) and all((r["_bad"], r["_host"], r["_lines"], r.total) == (1, 2, 3, 4) for r in found)
    table.write.parquet(f"{tmp_path}/documents.parquet")
    assert same_rows(spark, tmp_path, "op5_line_dedup")
    assert linededup.drop_boilerplate(table.limit(0)).count() == 0


# 6


def test_quality_classifier(spark):
    rng = random.Random(3)
    good = [words(rng, 60) + "." for _ in range(200)]
    bad = [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words(rng, 60).split()) for _ in range(80)]
    model = quality.fit(docs(spark, *good[:150], *bad[:60]), spark.createDataFrame([(i, int(i < 150)) for i in range(210)], "doc_id long, label int"))
    held = quality.with_quality(docs(spark, *good[150:], *bad[60:], None, "").withColumn("score", F.lit(0)), model).orderBy("doc_id").collect()
    right = sum(r.predicted == int(r.doc_id < 50) for r in held[:70])
    assert right >= 68 and all(0 <= r.score <= 1 for r in held) and held[70].score == held[71].score
    none = quality.fit(docs(spark, "a").limit(0), spark.createDataFrame([], "doc_id long, label int"))
    assert quality.with_quality(docs(spark, "a"), none).first().score == 0.5


def plain_score(model, text):
    """A score with nothing of the operator's but the model: zstandard, one text at a time."""
    data = (text or "").encode()
    sizes = []
    for raw in (model.bad, model.good):
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        pack = zstandard.ZstdCompressor(level=6, dict_data=d, write_checksum=False, write_content_size=False, write_dict_id=False)
        sizes.append(sum(len(pack.compress(data[i : i + 2048])) for i in range(0, len(data), 2048)))
    x = model.slope * (sizes[0] - sizes[1]) / (len(data) + 100) + model.weight * len(data) / (len(data) + 100) + model.prior
    return 1 / (1 + math.exp(-max(-30, min(30, x))))


def quality_tables(spark, path):
    rng = random.Random(33)
    texts = [words(rng, 60) + "." for _ in range(120)] + [" ".join(w + rng.choice(["###", "$$$", "%%%"]) for w in words(rng, 60).split()) for _ in range(50)]
    texts += [None, "", "tiny", words(rng, 20000), texts[0]]
    docs(spark, *texts).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 120), 0) for i in range(0, 170)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return texts


def test_quality_query_by_brute_force(spark, tmp_path):
    texts = quality_tables(spark, tmp_path)
    model = queries.quality_model(spark, str(tmp_path), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    rows = {r.doc_id: r for r in queries.op6_quality(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts)
    for i, t in enumerate(texts):
        assert rows[i].score == pytest.approx(plain_score(model, t), abs=1e-12)
        assert rows[i].predicted == int(rows[i].score >= 0.7) and rows[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert sum(rows[i].predicted == int(i < 120) for i in range(170)) >= 165 and len(model.good) <= 1 << 20
    assert rows[170].score == rows[171].score and rows[174].score == rows[0].score


# 7


@settings(max_examples=50, deadline=None)
@given(st.integers(0, 300), st.integers(0, 5))
def test_fisher_yates_is_a_permutation(n, seed):
    assert sorted(sharding.fisher_yates(n, (seed, 1)).tolist()) == list(range(n))


def test_sharding(spark, tmp_path):
    d = docs(spark, *[f"t{i}" for i in range(97)], None, "", "x").unionByName(docs(spark, *["same"] * 50)).withColumn("slot", F.lit(9))
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    placed = sharding.assign_shards(sharding.external_shuffle(d, size, bucket_bytes=60), 16).persist()
    rows = placed.collect()
    assert sorted((r.doc_id, r.text or "") for r in rows) == sorted((r.doc_id, r.text or "") for r in d.collect())
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r.slot)
    assert len(by) == 16 and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1 and len({r.bucket for r in rows}) > 3
    sharding.write_shards(placed, str(tmp_path / "shards"))
    assert spark.read.parquet(str(tmp_path / "shards")).count() == len(rows)
    assert sharding.external_shuffle(d.limit(0), size).count() == 0


def test_sharding_query_by_list_shuffles(spark, tmp_path, monkeypatch):
    rng = random.Random(71)
    texts = [words(rng, rng.randrange(30)) for _ in range(400)] + [None, "", "same", "same", "x" * 50000]
    docs(spark, *texts).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(sharding.external_shuffle, "__defaults__", (7, 4000))
    rows = {r.doc_id: r for r in queries.op7_sharding(spark, str(tmp_path)).collect()}
    sizes = [len((t or "").encode()) + 1 for t in texts]
    buckets = math.ceil(sum(sizes) / 4000)
    dealt = spark.range(len(texts)).select(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(buckets)).alias("b")).collect()
    order = []
    for b in range(buckets):
        members = [i for i, r in enumerate(dealt) if r.b == b]
        draws = np.random.default_rng((7, b)).integers(0, np.arange(1, len(members) + 1)).tolist() if members else []
        for i in range(len(members) - 1, 0, -1):
            members[i], members[draws[i]] = members[draws[i]], members[i]
        order += members
    assert buckets > 5 and len(rows) == len(texts)
    for rank, i in enumerate(order):
        r = rows[i]
        assert (r.shard, r.slot, r["size"], r.text_crc32, r.law, r.grown_shard) == (rank % 16, rank // 16, sizes[i], zlib.crc32((texts[i] or "").encode()), "rows", None)
    with pytest.raises(ValueError):
        sharding.external_shuffle(spark.read.parquet(f"{tmp_path}/documents.parquet"), F.lit(1 << 50))


# 8


def plain_chunks(data):
    """Content-defined chunks, a byte at a time."""
    out, start, h = [], 0, 0
    for i, byte in enumerate(data):
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
        size = i + 1 - start
        if size >= 256 and h >> 20 & 0x3FF == 0 or size == 4096:
            out.append(data[start : i + 1])
            start = i + 1
    return out + ([data[start:]] if start < len(data) else [])


def media_row(text):
    """What op8 returns for a text, but for the feature, with nothing of the operator's but the gear table."""
    data = (text or "").encode()
    whole = data + b"\xff" * (-len(data) % 576 if data else 576)
    chunks = plain_chunks(whole)
    form = b"CDC1" + len(chunks).to_bytes(4, "big") + len(data).to_bytes(8, "big")
    form += b"".join(hashlib.sha256(c).digest() + len(c).to_bytes(4, "big") for c in chunks) + whole
    return len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-32:]), len(form), hashlib.sha256(form).hexdigest(), len(chunks)


def test_media_by_brute_force(spark):
    rng = random.Random(8)
    long = words(rng, 6000)
    texts = [long, "x" + long, long, None, "", "short", "é" * 700, long[:20000] + words(rng, 50) + long[20000:], "abcd" * 9000, words(rng, 3000), "short", long + long, words(rng, 90000)]
    d = docs(spark, *texts).withColumn("sha256", F.lit(1)).withColumn("chunks", F.lit(1))
    for bits, df in ((24, d.repartition(3, "doc_id")), (6, d.coalesce(1)), (24, d.unionByName(d).repartition(4, "doc_id"))):
        rows = media.media_features(df, bits).collect()
        assert sorted({r.doc_id for r in rows}) == list(range(len(texts))) and len(rows) == df.count()
        for r in rows:
            assert (*r[1:7], int(r.feature.split(";")[0].removeprefix("chunks="))) == media_row(texts[r.doc_id])
        of = {r.doc_id: r[1:] for r in rows}
        assert of[0] == of[2] and of[3] == of[4] and of[5] == of[10]
    a, b = (set(media.chunks_of(media.payload_of(t)[0])) for t in texts[:2])
    assert len(a & b) > 0.8 * len(a)
    assert media.media_features(docs(spark, "a").limit(0)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.binary(min_size=1, max_size=6000))
def test_gear_chunks(data):
    chunks = media.chunks_of(data)
    assert b"".join(chunks) == data and all(len(c) <= media.MOST for c in chunks) and all(len(c) >= media.LEAST for c in chunks[:-1])
    h = 0
    for i, byte in enumerate(data[:100]):
        h = ((h << 1) + int(media.GEAR[byte])) & 0xFFFFFFFF
    if len(data) >= 100:
        assert (100 in media.gear_cuts(np.frombuffer(data, np.uint8)).tolist()) == ((h & int(media.MASK)) == 0)


# 9


def brute_rule(url):
    """The longest rule that fits, by string methods."""
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.split("[/?#]", rest, maxsplit=1)[0]
        path = re.split("[?#]", rest[len(host) :], maxsplit=1)[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    best = None
    for said, rule in urlfilter.RULES:
        at, slash, start = rule.partition("/")
        if (host == at or host.endswith("." + at)) and path.startswith(slash + start) and (best is None or len(rule) > len(best[1])):
            best = said, rule
    return host, path, best[1] if best else None, best[0] if best else None


def site_pages(rng, hosts):
    """Pages of good hosts, hyphenated or not, and of bad ones: long random names with digits and queries. What they show tells them apart."""
    rows, bad = [], []
    for i in range(hosts):
        wrong = i % 3 == 0
        host = "".join(rng.choice("bcdfgxz0123456789") for _ in range(18)) if wrong else rng.choice(("-", "")).join(words(rng, rng.choice((1, 2))).split())
        for n in range(8):
            text = words(rng, 80)
            text = " ".join(w + rng.choice(("$$$", "###", "%%%")) for w in text.split()) if wrong else text + "."
            tail = f"?id={rng.randrange(10**9)}&s={rng.randrange(10**9)}" if wrong else ""
            rows.append((len(rows), f"http://{host}.example.net/a/{n}{tail}", f"<html><style>p{{}}</style><p>{text}</p></html>"))
            bad.append(int(wrong))
    return rows, bad


def url_tables(spark, path):
    rng = random.Random(91)
    rows, bad = site_pages(rng, 90)
    odd = ["https://A.Example.ORG/en/12?x=/es/", "http://example.org/es/1", "http://notexample.org/es/1", "http://x.com/fr/1", "http://com/de/2", "http://x.com/en", None, "no scheme", "", "http://x.org", "HTTP://É.Example.org/es/?a://b", "http://example.org?/es/", "a://b://example.org/es/", "http://com\n/de/" + "x" * 50000, "http://x.org"]
    rows += [(len(rows) + i, u, None if i % 2 else "") for i, u in enumerate(odd)]
    spark.createDataFrame([(*r, "s") for r in rows], "page_id long, url string, html string, score string").write.parquet(f"{path}/pages.parquet")
    texts = [words(rng, 60) + "." for _ in range(60)] + [" ".join(w + rng.choice(("$$$", "&&&", "***")) for w in words(rng, 60).split()) for _ in range(60)]
    docs(spark, *texts).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 60), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return rows, bad


def test_url_rules_and_trees_by_brute_force(spark, tmp_path):
    rows, bad = url_tables(spark, tmp_path)
    judged = queries.op9_url_filter(spark, str(tmp_path))
    plan = judged._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    found = {r.page_id: r for r in judged.collect()}
    assert len(found) == len(rows)
    for page, url, _ in rows:
        r, (host, path, rule, said) = found[page], brute_rule(url)
        assert (r.host, r.path, r.rule) == (host, path, rule), url
        assert r.verdict == (said or ("block" if r.score >= 0.5 else "allow"))
    assert all((found[i].verdict == "block") == bool(b) for i, b in enumerate(bad))
    assert sum("-" in found[i].host for i, b in enumerate(bad) if not b) > 50  # hyphens are no reason to block
    labelled = queries.url_labels(spark, str(tmp_path))
    assert {(r.url, r.label) for r in labelled.collect()} == {(rows[i][1], b) for i, b in enumerate(bad)}
    told = urlfilter.held_out(labelled)
    assert told[1, 1] >= 0.9 * (told[1, 1] + told.get((1, 0), 0)) and told[1, 1] >= 0.9 * (told[1, 1] + told.get((0, 1), 0))


def test_urls_without_labels_or_rows(spark, tmp_path):
    url_tables(spark, tmp_path)
    pages, documents, labels = (spark.read.parquet(f"{tmp_path}/{t}.parquet") for t in ("pages", "documents", "labels"))
    labels = labels.withColumnRenamed("quality", "label")
    none = urlfilter.labelled_pages(pages, documents, labels.where("label = 1"))
    assert none.count() == 0 and none.columns == ["url", "label"]
    assert {r.verdict for r in urlfilter.judge(pages, none).where("rule IS NULL").collect()} == {"allow"}
    assert urlfilter.judge(pages.limit(0), none).count() == 0 == urlfilter.labelled_pages(pages.limit(0), documents, labels).count()
    shown = spark.createDataFrame([("<p>a &amp;lt; b<!-- c --><script>d</script></p>",)], "html string").select(urlfilter.page_text(F.col("html")).alias("t")).first().t
    assert shown.split() == ["a", "&lt;", "b"]


# 10


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(queries.VOCABULARY)), bpe.Vocabulary(queries.vocabulary_text())


def test_bpe_is_what_the_library_says(spark, tokenizer):
    library, vocabulary = tokenizer
    rng = random.Random(6)
    texts = ["", "Hello's WORLD's 123", "ΣΑΣ İstanbul ½ e\u0301\u0301 \x85 a\u00a0b", "<|endoftext|>a<|startoftext|>", "x" * 3000, "ab" * 900 + " " + "aab" * 500]
    texts += ["".join(rng.choice("thein' sdé1.,<|\n") for _ in range(rng.randrange(60))) for _ in range(300)]
    for (ids, decoded), t in zip(bpe.Encoder(vocabulary, max_words=50).encode(texts), texts, strict=True):
        want = library.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert decoded.decode() == library.decode(want, skip_special_tokens=False) == bpe.Encoder(vocabulary).decode(ids)
    rows = bpe.encode_documents(docs(spark, "a b", None).withColumn("ids", F.lit(1)), queries.vocabulary_text(), with_ids=True).orderBy("doc_id").collect()
    assert [r.n_tokens for r in rows] == [2, 0] and rows[1].ids_sha256 == hashlib.sha256(b"").hexdigest()


def test_few_and_long_words_are_merged_as_many_are(tokenizer, monkeypatch):
    library, v = tokenizer
    rng = random.Random(61)
    some = ["".join(rng.choice("etaoinshr") for _ in range(rng.randrange(1, 40))) for _ in range(400)] + ["é", "a", "日本"]
    batched = [x.tolist() for x in bpe.encode_words(v, some)]
    monkeypatch.setattr(bpe, "FEW", 10**9)
    assert batched == [x.tolist() for x in bpe.encode_words(v, some)]
    long = ["".join(rng.choice("etaoinshrdlu") for _ in range(60000)), "z" * 50001]
    assert [x.tolist() for x in bpe.encode_words(v, long)] == [library.encode(w, add_special_tokens=False).ids for w in long]


def test_clashing_names_and_long_texts_of_bpe(spark, tokenizer):
    library, _ = tokenizer
    text = "word soup, " * 40000
    df = docs(spark, text).withColumn("ids", F.lit(1)).withColumn("N_TOKENS", F.lit(2)).withColumn("odd name, x", F.lit(3))
    row = bpe.encode_documents(df, queries.vocabulary_text()).first()
    assert row["ids"] == 1 and row["odd name, x"] == 3 and row.n_tokens == len(library.encode(text, add_special_tokens=False).ids)


def test_pair_forest_takes_the_leftmost_least_rank(tokenizer):
    _, v = tokenizer
    merges = json.loads(queries.vocabulary_text())["model"]["merges"]
    ranks = {tuple(m): i for i, m in enumerate(merges)}
    symbols = bpe.byte_symbols()
    for w in ("thethe", "aaaa", "nationalisation", "b", "zzzzzzzzz", "ththththth"):
        parts = [symbols[b] for b in w.encode()]
        parts[-1] += "</w>"
        while True:
            best = min(((ranks.get(p, math.inf), i) for i, p in enumerate(itertools.pairwise(parts))), default=(math.inf, 0))
            if best[0] == math.inf:
                break
            parts[best[1] : best[1] + 2] = ["".join(parts[best[1] : best[1] + 2])]
        assert [v.tokens[i].decode() for i in bpe.encode_words(v, [w])[0].tolist()] == parts


# plumbing and pipeline


def test_bitmap_and_shared_folder(spark):
    keys = spark.range(500).select(F.xxhash64("id").alias("h"))
    bitmap = KeyBitmap.of(keys, "h", 14)
    assert bitmap.has(np.array([r.h for r in keys.collect()], np.int64)).all()
    assert bitmap.has(np.arange(10**6, 10**6 + 4000, dtype=np.int64) * 7919).mean() < 0.2
    assert materialize(keys.limit(0), "none").count() == 0


def test_pipeline_by_brute_force(spark, tmp_path, tokenizer):
    """Every stage again with plain lists: zstandard, dictionaries, sets of shingles, aligned words, the library."""
    import corpus_pipeline

    library, _ = tokenizer
    rng = random.Random(12)
    item = words(rng, 20)
    clean = [words(rng, 80) for _ in range(60)]
    near = clean[1].replace(clean[1].split()[40], "edit")
    texts = [*clean, clean[0], near, words(rng, 30) + " " + item + " " + words(rng, 30), None, "", "what is the capital of france now"]
    texts = [t if not t else "Common line of the site\n" + t for t in texts]
    junk = [" ".join(w + "$$$" for w in words(rng, 60).split()) for _ in range(30)]
    rows = [(i, t, "en", rng.choice("ab"), len(t or "")) for i, t in enumerate(texts + junk)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i < len(texts)), 0) for i in range(len(rows))], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    items = {1: item, 2: "the capital of france"}
    spark.createDataFrame(list(items.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    model = queries.quality_model(spark, str(tmp_path), F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    left = [(i, t, s) for i, t, _, s, _ in rows if plain_score(model, t) >= 0.7]
    on, total = Counter(), Counter(s for _, _, s in left)
    on.update((s, line) for _, t, s in left for line in {x.strip(" ") for x in (t or "").split("\n")})
    cut = lambda t, s: None if t is None else "\n".join(x for x in t.split("\n") if not x.strip(" ") or on[s, x.strip(" ")] - 1 <= 0.05 * total[s])
    left = [(i, cut(t, s)) for i, t, s in left]
    group, sizes = brute_components([t for _, t in left], 5, 80)
    left = [left[k] for k in range(len(left)) if group[k] == k or not sizes[k]]
    hit = {k for k, _ in brute_overlaps([t for _, t in left], items)}
    left = {i: t for k, (i, t) in enumerate(left) if k not in hit}
    assert not {60, 61, 62, 65} & set(left) and set(range(60)) <= set(left)

    found = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(found) == set(left)
    for i, t in left.items():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert found[i].n_tokens == len(ids) and found[i].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert found[i].n_chars == (None if t is None else len(t))


def test_every_query_runs(spark):
    """Each registered query over the smallest tables, and its SQL, where there is one."""
    sf = "/root/testdata/sf0.001"
    if not pathlib.Path(sf).is_dir():
        pytest.skip("needs the driver's tables")
    for name, query in queries.QUERIES.items():
        assert same_rows(spark, sf, name) if name in queries.ORACLE_SQL else query(spark, sf).count() > 0, name


def test_first_copies_with_null_and_repeated_ids(spark):
    import corpus_pipeline

    rng = random.Random(23)
    a, b, c, d, e = (words(rng, 60) for _ in range(5))
    near = a.replace(a.split()[30], "edit")
    rows = [(3, a), (None, near), (None, b), (None, b), (7, c), (7, c), (7, d), (8, d), (5, d), (9, e), (9, a), (None, ""), (None, ""), (1, None)]
    table = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS)
    kept = corpus_pipeline.keep_first_copies(spark, table, "")
    assert kept.columns == table.columns
    want = [(3, a), (None, b), (7, c), (5, d), (9, e), (None, ""), (None, ""), (1, None)]
    assert sorted(map(repr, [(r.doc_id, r.text) for r in kept.collect()])) == sorted(map(repr, want))
    unique = table.where("doc_id IN (3, 5, 8)")
    assert sorted(r.doc_id for r in corpus_pipeline.keep_first_copies(spark, unique, "").collect()) == [3, 5]
    assert corpus_pipeline.keep_first_copies(spark, table.limit(0), "").count() == 0
