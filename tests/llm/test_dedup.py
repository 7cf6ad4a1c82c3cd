"""Exact, substring, suffix-array and SimHash dedup against brute force."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.llm.cases import table, texts, words_of
from tidemark.llm import countmin, exact, keybits, repeats, simhash, substring, suffix
from tidemark.llm.components import components
from tidemark.llm.quotient import QuotientFilter


def sha(data) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def counted(df, *cols):
    return Counter(tuple(r[c] for c in cols) for r in df.collect())


# ---- exact ----
def brute_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = Counter()
    for i, t in rows:
        ids = [x for x in groups[t or ""] if x is not None]
        keep = max(ids, default=None)
        out[(i, keep, len(groups[t or ""]), i == keep, sha(t or ""))] += 1
    return out


def test_exact_classes(spark):
    got = counted(exact.exact_classes(table(spark)), "doc_id", "keep_id", "group_size", "kept", "text_sha256")
    assert got == brute_exact(texts())


def test_exact_classes_of_nothing(spark):
    assert exact.exact_classes(table(spark, [])).count() == 0


@given(st.lists(st.lists(st.integers(0, 2**56 - 1), max_size=40), max_size=5))
def test_quotient_filters_merge_losslessly(parts):
    held, want = QuotientFilter.of(np.zeros(0, np.uint64)), Counter()
    for part in parts:
        want.update(part)
        one = QuotientFilter.of(np.array(part, np.uint64))
        held = held.merge(QuotientFilter.from_bytes(one.to_bytes()) if part else one)
    assert dict(zip(held.keys.tolist(), held.counts.tolist(), strict=True)) == dict(want)
    assert set(held.repeated().tolist()) == {k for k, n in want.items() if n > 1}
    assert all(held.count(k) == n for k, n in want.items()) and held.count(1 << 60) == 0


# ---- substrings by words ----
def brute_substrings(rows, window):
    lists = [words_of(t) for _, t in rows]
    counts = Counter(tuple(w[k : k + window]) for w in lists for k in range(len(w) - window + 1))
    out = Counter()
    for (i, _), w in zip(rows, lists, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - window + 1):
            if counts[tuple(w[k : k + window])] > 1:
                gone[k : k + window] = True
        out[(i, len(w), int(gone.sum()), " ".join(x for x, g in zip(w, gone, strict=True) if not g))] += 1
    return out


@pytest.mark.parametrize("width", [20, 28])
def test_substrings(spark, width):
    got = counted(substring.dedup_substrings(table(spark), width=width), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute_substrings(texts(), 35)


def thue_morse(n: int) -> str:
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


def test_words_are_compared_not_hashes(spark):
    """Two words that any polynomial of an odd base modulo 2^64 hashes alike."""
    one = thue_morse(1024)
    other = one.translate(str.maketrans("ab", "ba"))
    same = [f"w{k}" for k in range(34)]
    rows = [(1, " ".join([*same, one])), (2, " ".join([*same, other])), (3, " ".join([one] * 36)), (4, " ".join([other] * 35))]
    got = counted(substring.dedup_substrings(table(spark, rows)), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute_substrings(rows, 35)
    assert {(i, n) for i, _, n, _ in got} == {(1, 0), (2, 0), (3, 36), (4, 0)}


def test_one_row_many_times(spark):
    """A row repeated over and over, null ids among them: its spans are a set."""
    text = " ".join(f"w{k % 50}" for k in range(120))
    rows = [(None, text)] * 300 + [(7, text)] * 200 + [(8, "alone " + text[:90])]
    got = counted(substring.dedup_substrings(table(spark, rows)), "doc_id", "n_words", "n_removed", "kept")
    assert got == brute_substrings(rows, 35)
    got = counted(repeats.dedup_bytes(table(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(rows, 50)


def test_substrings_of_nothing(spark):
    assert substring.dedup_substrings(table(spark, [])).count() == 0
    assert counted(substring.dedup_substrings(table(spark, [(1, None), (2, "a")])), "doc_id", "n_words", "n_removed") == Counter({(1, 0, 0): 1, (2, 1, 0): 1})


@given(st.lists(st.integers(0, 50), max_size=200))
def test_sketch_never_underestimates(values):
    items = np.array(values, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    counters = np.zeros(countmin.DEPTH << 20, np.int64)
    for part in np.array_split(items, 3):
        for segment, at, more in countmin.sketch(part, 20):
            where, n = countmin.read_sketch(at, more)
            counters[(segment << countmin.SEGMENT) + where] += n
    bitmap = np.packbits(counters > 1, bitorder="little")
    repeated = countmin.estimated_repeated(items, bitmap, 20)
    counts = Counter(values)
    assert all(r for v, r in zip(values, repeated, strict=True) if counts[v] > 1)


def test_keys_that_come_once_take_no_room_in_a_bitmap(spark):
    df = spark.range(3_000_000).union(spark.range(1000))
    items = np.arange(3_000_000, dtype=np.uint64)
    let = keybits.passed(items, keybits.key_bits(df, keybits.long_keys, 20, least=2))  # a bit for three keys
    assert let[:1000].all() and let[1000:].mean() < 0.01
    cells = countmin.repeated_cells(df, keybits.long_keys, 20)
    assert countmin.estimated_repeated(items, cells, 20)[1000:].mean() > 0.8  # what op5 went by before
    let = keybits.passed(items, keybits.key_bits(df.where("id >= 2990000"), keybits.long_keys, 20))
    assert let[2990000:].all() and let[:2990000].mean() < 0.01
    assert not keybits.key_bits(df.where("id < 0"), keybits.long_keys, 20).any()


# ---- suffix arrays ----
def brute_bytes(rows, window):
    order = lambda i: (i is None, i or 0)
    first: dict[bytes, tuple] = {}
    for i, t in sorted(rows, key=lambda r: order(r[0])):
        data = (t or "").encode()
        for k in range(len(data) - window + 1):
            first.setdefault(data[k : k + window], order(i))
    out = Counter()
    for i, t in rows:
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for k in range(len(data) - window + 1):
            if first[data[k : k + window]] < order(i):
                gone[k : k + window] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum())
        out[(i, len(data), int(gone.sum()), spans, sha(bytes(b for b, g in zip(data, gone, strict=True) if not g)))] += 1
    return out


@pytest.mark.parametrize(("limit", "block"), [(repeats.LIMIT, repeats.BLOCK), (2, 256), (repeats.LIMIT, 256)])
def test_bytes(spark, limit, block):
    got = counted(repeats.dedup_bytes(table(spark), limit=limit, block=block), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(texts(), 50)


def test_bytes_go_by_the_array_alone(spark, monkeypatch):
    """Without the repeats of the array nothing goes but whole-text copies of at least a window."""
    empty = lambda self, least: (np.zeros(0, np.int64),) * 3
    monkeypatch.setattr(suffix.SuffixArray, "maximal_repeats", empty)
    import pyarrow as pa

    lists = lambda n: pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array(np.zeros(0, np.int64)))
    rows = [(1, "a" * 10 + "bcd" * 40), (2, "bcd" * 40), (3, "bcd" * 40)]
    t = pa.table({"part": [1, 1], "doc": [1, 2], "last": [1, 3], "segment": [b"bcd" * 20, b"x" + b"bcd" * 20]})
    assert repeats.Repeats(t, 50).marks(2) == (lists(2), lists(2))
    monkeypatch.undo()
    assert repeats.Repeats(t, 50).marks(2) != (lists(2), lists(2))
    got = counted(repeats.dedup_bytes(table(spark, rows)), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_bytes(rows, 50)


def test_repeat_groups_have_all_occurrences(spark):
    rows = [(i, t) for i, t in texts() if i is not None and 50 <= len(t or "") < 3000]
    for limit in (repeats.LIMIT, 3):
        got = repeats.repeat_groups(table(spark, rows), limit=limit).collect()
        data = defaultdict(set)
        for i, t in rows:
            data[i].add(t.encode())
        groups = defaultdict(set)
        for r in got:
            groups[r["group"], r["length"]].add((r["doc_id"], r["start"]))
        assert groups
        for (name, length), places in groups.items():
            found = {t[s : s + length] for i, s in places for t in data[i] if hashlib.sha256(t[s : s + length]).hexdigest()[:32] == name}
            assert len(found) == 1 and length >= 50
            one = found.pop()
            assert places == {(i, s) for i, ts in data.items() for t in ts for s in range(len(t)) if t.startswith(one, s)}
        covered = {(i, s + k) for (_, length), places in groups.items() for i, s in places for k in range(length)}
        counts = defaultdict(set)
        for i, ts in data.items():
            for t in ts:
                for k in range(len(t) - 49):
                    counts[t[k : k + 50]].add((i, k))
        want = {(i, s + k) for places in counts.values() if len({i for i, _ in places}) > 1 for i, s in places for k in range(50)}
        assert want <= covered


def test_bytes_of_nothing(spark):
    assert repeats.dedup_bytes(table(spark, [])).count() == 0


@given(st.lists(st.text("ab", max_size=14), min_size=1, max_size=5))
def test_maximal_repeats(parts):
    """Every maximal repeat of the texts, with all its occurrences, and no other."""
    least = 2
    data = [p.encode() for p in parts]
    ends = np.cumsum([len(d) for d in data])
    body = np.frombuffer(b"".join(data), np.uint8)
    array = suffix.SuffixArray(body, ends - [len(d) for d in data], ends, np.zeros(len(data), np.int64), least)
    got = {}
    for length, a, b in zip(*(x.tolist() for x in array.maximal_repeats(least)), strict=True):
        at = {(int(t), int(o)) for t, o in zip(array.text[a : b + 1], array.offset[a : b + 1], strict=True)}
        t, o = next(iter(at))
        got[data[t][o : o + length]] = at
    want = {}
    for s in {d[i:j] for d in data for i in range(len(d)) for j in range(i + least, len(d) + 1)}:
        at = {(t, o) for t, d in enumerate(data) for o in range(len(d) - len(s) + 1) if d[o : o + len(s)] == s}
        left = [data[t][o - 1] if o else -1 - k for k, (t, o) in enumerate(at)]
        right = [data[t][o + len(s)] if o + len(s) < len(data[t]) else -1 - k for k, (t, o) in enumerate(at)]
        if len(at) > 1 and len(set(left)) > 1 and len(set(right)) > 1:
            want[s] = at
    assert got == want


# ---- SimHash ----
def brute_fingerprint(text) -> int:
    w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    label = {i: i for i, _ in prints}
    while True:
        moved = False
        for i, a in prints:
            for j, b in prints:
                if bin(a ^ b).count("1") <= 3 and label[j] < label[i]:
                    label[i], moved = label[j], True
        if not moved:
            return label


def test_near_components(spark):
    rows = texts()
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    label = brute_components([p for p in prints if p[0] is not None])
    want = Counter((i, f, label.get(i)) for i, f in prints)
    got = Counter((i, f & (1 << 64) - 1, c) for i, f, c in (tuple(r) for r in simhash.near_components(table(spark)).collect()))
    assert got == want
    assert simhash.near_components(table(spark, [])).count() == 0


@given(st.integers(0, 2**64 - 1), st.sets(st.integers(0, 63), max_size=3))
def test_close_halves_meet_at_an_anchor(x, bits):
    y = x
    for b in bits:
        y ^= 1 << b
    met = False
    for shift in (0, 32):
        a, b = (np.array([v >> shift & 0xFFFFFFFF], np.int64) for v in (x, y))
        met |= int(simhash.home_anchor(a)[0]) in set(simhash.near_anchors(b)[1].tolist())
    assert met


def test_anchors_are_a_covering_code():
    x = np.random.default_rng(1).integers(0, 1 << 32, 5000)
    home = simhash.home_anchor(x)
    assert max(bin(a ^ b).count("1") for a, b in zip(x.tolist(), home.tolist(), strict=True)) <= 1
    assert (simhash.home_anchor(home) == home).all()
    index, near = simhash.near_anchors(x)
    assert max(bin(int(x[i]) ^ int(a)).count("1") for i, a in zip(index, near, strict=True)) <= 2
    assert set(np.bincount(index).tolist()) <= {2, 17}


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(0, 60)] + [(100, 101), (101, 100), (200, 5), (300, 301)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(1, 61)} | {200: 0, 101: 100, 301: 300}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("most", [1 << 26, 1 << 12, 8])
def test_key_bitmap_loses_no_key(spark, most):
    from tidemark.llm.common import KeyBitmap

    keys, rows = spark.range(0, 300, 3), spark.range(300)
    bitmap = KeyBitmap(keys, "id", most=most)
    held, others = ({r[0] for r in f(rows, "id").collect()} for f in (bitmap.held, bitmap.others))
    assert held | others == set(range(300)) and not held & others and held >= set(range(0, 300, 3))
    assert len(held) < 150 if most > 1 << 12 else held


def test_tables_that_grow_with_the_documents_are_not_broadcast(spark):
    """Spark takes them for as small as their files: both sides of their joins are dealt out all the same."""
    nodes = spark.range(64).select(F.xxhash64("id").alias("fp"), "id")
    links = simhash.near_links(nodes)
    assert "BroadcastHashJoin" not in links._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
    assert "BroadcastHashJoin" not in simhash.near_components(table(spark))._jdf.queryExecution().executedPlan().toString()  # noqa: SLF001
