"""Each operator against brute force on a small fixture, and its edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from ledgerlake.llm import exact_dedup, hmm_score, language_id, mixing, near_dedup, packing, token_counts, token_records, toxicity, winnowing
from ledgerlake.llm.common import documents, hashed, scratch_path
from ledgerlake.llm.encode import Encoder
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 977}" for i in range(30_000))
#: nulls, empty and blank texts, repeated rows and ids, ties, a very long text, junk
EDGE = [
    (1, "a b c d e f g h"), (2, None), (3, ""), (4, " \t\n "), (5, "a  b c\nd e f g h"), (6, LONG), (6, LONG), (7, "x"), (7, "y z"), (None, "a b c d e f g h"), (None, None),
    (8, "A B C D E F G H"), (9, "naïve Ärger ß 中文 !!! 😀"), (10, "'s it's\x1c odd  . ."), (11, LONG + " tail"),
]


def rows(df):
    return df.collect()


def encoded(name, text, end):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


# --- encoder

_WORD = Encoder(public_tokenizers.path("word_bpe_49k.json"), "dropped")
_BYTE = Encoder(public_tokenizers.path("byte_bpe_50k.json"), "leading")
_MIXED = [*"abZéÉ中ßHT1.,;'!?_-#@<|>", " ", "  ", "\n", "\n\n", "\t", "\r\n", "\x1c", "\xa0", "\u2003", "\u3000", "\u0085", "\u0301", "\u0308", "\u0331", "\u0338", "don't", "'S", "word", "Straße", "<|endoftext|>", "<|ENDOFTEXT|>", "<|startoftext|>", "Σ", "İ", "×", "😀", "ª"]
_TEXT = st.lists(st.sampled_from(_MIXED), max_size=30).map("".join)


@given(st.lists(_TEXT, min_size=1, max_size=4))
@settings(max_examples=500, deadline=None)
def test_cached_encoding_is_the_librarys(texts):
    for e in (_WORD, _BYTE):
        ids, at = e.encode(pa.array([*texts, None]))
        assert len(at) == len(texts) + 2 and at[-1] == at[-2] == len(ids)
        for k, text in enumerate(texts):
            assert ids[at[k] : at[k + 1]].tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("entries", [1_000_000, 2000])
def test_encoding_of_the_whole_corpus_is_the_librarys(spark, entries):
    """Also where the cache has room for few pieces and is begun anew again and again."""
    texts = [r.text for r in rows(documents(spark, "/root/testdata/sf0.01"))] + [t for _, t in EDGE]
    for name, mode in (("word_bpe_49k.json", "dropped"), ("byte_bpe_50k.json", "leading")):
        e = Encoder(public_tokenizers.path(name), mode, entries)
        plain = e.tokenizer.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)
        for begin in range(0, len(texts), 256):
            ids, at = e.encode(pa.array(texts[begin : begin + 256]), 7)
            for k in range(len(at) - 1):
                assert ids[at[k] : at[k + 1]].tolist() == [*plain[begin + k].ids, 7]


# --- 1 token records


def test_token_records_edge_cases(spark, docs):
    df = docs(EDGE)
    m = token_records.write_token_records(df, scratch_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "dropped", 1, 49408)
    got = rows(token_records.read_token_records(m).orderBy("start"))
    at, want = 0, Counter()
    for i, t in EDGE:
        ids = encoded("word_bpe_49k.json", t, 1)
        want[(i, len(ids), zlib.crc32(ids.tobytes()))] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    assert [r.doc_id for r in got] == sorted((i for i, _ in EDGE), key=lambda i: (i is not None, i or 0))
    for r in got:
        assert r.start == at
        at += r.n_tokens


def test_token_records_of_an_empty_table(spark, docs):
    m = token_records.write_token_records(docs([]), scratch_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "dropped", 1, 49408)
    assert rows(token_records.read_token_records(m)) == []


def test_records_are_read_in_shuffled_order(spark, docs):
    """Through the index, over several files a task, as files are small."""
    df = docs(EDGE)
    m = token_records.write_token_records(df, scratch_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "dropped", 1, 49408, file_bytes=60)
    files = rows(m)
    assert len(files) > 4 and sum(f.n_records for f in files) == len(EDGE)
    want = Counter((i, tuple(encoded("word_bpe_49k.json", t, 1).tolist())) for i, t in EDGE)
    first, second = (rows(token_records.read_shuffled(m, seed)) for seed in (1, 2))
    assert Counter((r.doc_id, tuple(r.ids)) for r in first) == want == Counter((r.doc_id, tuple(r.ids)) for r in second)
    assert [r.position for r in first] == sorted(r.position for r in first) and [r.doc_id for r in first] != [r.doc_id for r in second]
    one = max(files, key=lambda f: f.n_records)
    f = token_records.RecordFile(one.file)
    assert len(f) == one.n_records and all(len(f[k][1]) > 0 for k in reversed(range(len(f))))


def test_a_damaged_or_foreign_index_is_refused(spark, docs):
    m = token_records.write_token_records(docs([(1, "a b"), (2, "c d e"), (3, "f")]).coalesce(1), scratch_path(spark, "t"), public_tokenizers.path("word_bpe_49k.json"), "dropped", 1, 49408)
    file = max(rows(m), key=lambda f: f.n_records).file
    path = file.removeprefix("file:").replace("///", "/", 1).removesuffix(".rec") + ".idx"
    index = open(path, "rb").read()
    open(path, "wb").write(index[:8] + b"\x01" + index[9:])
    with pytest.raises(ValueError):
        token_records.RecordFile(file)[0]
    with pytest.raises(Exception, match="length of record|index"):
        rows(token_records.read_token_records(m))


def test_frames_detect_damage():
    frame = bytearray(token_records.frame(token_records.payload(7, np.arange(5, dtype="<u2").tobytes(), 2)))
    body, end = token_records.read_frame(memoryview(bytes(frame)), 0)
    assert end == len(frame) and token_records.unpack(body)[0] == 7 and list(token_records.unpack(body)[1]) == [0, 1, 2, 3, 4]
    for at in (0, 9, 20, len(frame) - 1):
        bad = bytearray(frame)
        bad[at] ^= 1
        with pytest.raises(ValueError):
            token_records.read_frame(memoryview(bytes(bad)), 0)


# --- 2 exact dedup


def test_exact_dedup_matches_its_oracle(spark):
    same(exact_dedup.op2_exact_dedup(spark, SF), connect(SF), exact_dedup.ORACLE)


@pytest.mark.parametrize("shape", [None, (1, 1), (3, 2)])
def test_exact_dedup_edge_cases(spark, docs, shape):
    """Also with a filter of one word, which is full, and with one of several ranges: the result is the same."""
    df = docs(EDGE)
    norm = [re.sub(r"[\x20\x09-\x0d]+", " ", t or "") for _, t in EDGE]
    groups = {}
    for (i, _), t in zip(EDGE, norm):
        groups.setdefault(t, []).append(i)
    least = lambda t: min((i for i in groups[t] if i is not None), default=None)
    want = Counter((i, least(t), len(groups[t]), i == least(t), hashlib.sha256(t.encode()).hexdigest()) for (i, _), t in zip(EDGE, norm))
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows(exact_dedup.find_copies(exact_dedup.hash_texts(df), shape)))
    assert got == want
    kept = rows(exact_dedup.drop_copies(df, shape=shape))
    assert len(kept) == len(groups) and {(r.doc_id) for r in kept} == {least(t) for t in groups}
    assert exact_dedup.drop_copies(df).columns == df.columns
    assert rows(exact_dedup.drop_copies(docs([]))) == []


def test_filter_never_fills():
    for rows_ in (1, 1000, 10**5, 10**7, 10**9, 10**11):
        ranges, words = shape = exact_dedup.filter_shape(rows_)
        assert ranges * words * 64 >= rows_ * exact_dedup.BITS_PER_ROW and words * 64 <= exact_dedup.RANGE_BITS
        assert exact_dedup.false_alarms(rows_, shape) < 0.05


def test_unique_rows_pass_straight_through(spark, docs, monkeypatch):
    """As many false alarms as calculated, no repeated row missed, and a hot group of copies."""
    n = 6000
    df = docs([(i, f"text {i}" if i % 3 else "copy") for i in range(n)])
    for shape in ((1, n // 4), (7, n // 28)):
        marked = {r.doc_id: r.maybe for r in rows(exact_dedup.maybe_repeated(exact_dedup.hash_texts(df), shape=shape))}
        alarms = sum(marked[i] for i in range(n) if i % 3) / (2 * n / 3)
        assert all(marked[i] for i in range(0, n, 3)) and alarms < 0.03 and alarms < 2 * exact_dedup.false_alarms(2 * n // 3, shape) + 0.005
    assert sorted(r.doc_id for r in rows(exact_dedup.drop_copies(df))) == [0, *(i for i in range(n) if i % 3)]
    monkeypatch.setattr("ledgerlake.llm.common.FEW", 0)  # the same without a broadcast
    assert exact_dedup.drop_copies(df).count() == 1 + 2 * n // 3


def test_exact_dedup_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b", "x", 1, True), (2, "a \t b", "y", 2, None), (1, "a b", "z", 3, None)], "doc_id long, text string, sha string, id int, stays boolean")
    got = rows(exact_dedup.drop_copies(df))
    assert exact_dedup.drop_copies(df).columns == df.columns and [(r.doc_id, r.text) for r in got] == [(1, "a b")]


# --- 3 packing


def check_packing(pieces, texts, capacity=1024):
    ids = {}
    for i, t in texts:
        ids.setdefault(i, []).append(encoded("byte_bpe_50k.json", t, 0))
    sequences, covered = {}, Counter()
    for p in pieces:
        assert any(zlib.crc32(x[p.start : p.start + p.length].tobytes()) == p.ids_crc32 and p.doc_tokens == len(x) for x in ids[p.doc_id])
        covered[p.doc_id] += p.length
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert covered == Counter({i: sum(map(len, x)) for i, x in ids.items()})
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_packing_edge_cases(spark, docs):
    df = docs(EDGE)
    s = check_packing(rows(packing.pack_documents(df, public_tokenizers.path("byte_bpe_50k.json"), "leading", 0)), EDGE)
    partial = [sum(n for _, n in x) for x in s.values() if sum(n for _, n in x) < 1024]
    assert len(partial) <= df.rdd.getNumPartitions()
    assert rows(packing.pack_documents(docs([]), public_tokenizers.path("byte_bpe_50k.json"), "leading", 0)) == []


def test_pool_drains_and_fills_every_sequence():
    """More remainders than the pool holds: it is packed down to its lower bound, then empty, and only the last sequence has room."""
    rng, packer, done, largest = np.random.default_rng(6), packing.Packer(), [], 0
    sizes = rng.integers(1, 3000, 12_000)
    for i, n in enumerate(sizes):
        done += packer.add(i, bytes(4 * int(n)))
        largest = max(largest, packer.size)
    assert largest == packing.POOL_HIGH - 1 and packer.size >= packing.POOL_LOW
    done += packer.drain()
    used = [sum(len(p[2]) for p in s) // 4 for s in done]
    assert packer.size == 0 and max(used) == 1024 and sum(u < 1024 for u in used) <= 1 and sum(used) == sizes.sum()
    whole = Counter()
    for s in done:
        for doc, start, ids, total in s:
            whole[doc] += len(ids) // 4
            assert start + len(ids) // 4 <= total == sizes[doc]
    assert all(whole[i] == n for i, n in enumerate(sizes))


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 3), max_size=6), st.integers(1, 60))
@settings(max_examples=300, deadline=None)
def test_closest_fill_is_optimal(counts, capacity):
    sums = {0}
    for length, n in counts.items():
        sums = {s + k * length for s in sums for k in range(n + 1)}
    chosen = packing.closest_fill(counts, capacity)
    assert all(n <= counts[length] for length, n in chosen.items())
    assert sum(length * n for length, n in chosen.items()) == max(s for s in sums if s <= capacity)


# --- 4 near duplicates


def brute_components(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                parent[root(a)] = root(b)
    out = []
    for k, (i, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if root(j) == root(k) and texts[j][0] is not None]
        least = min(ids, default=None) if sets[k] else i
        out.append((i, len(sets[k]), least, i == least))
    return Counter(out)


def near(df):
    return Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in rows(near_dedup.near_duplicates(df)))


def test_near_dedup_edge_cases(spark, docs):
    assert near(docs(EDGE)) == brute_components(EDGE)
    assert near(docs([])) == Counter()


@pytest.mark.parametrize("block,most", [(64, 200_000), (4, 0)])
def test_near_dedup_against_brute_force(spark, docs, block, most, monkeypatch):
    """Chains, a large group with edits of many degrees, and a passage that all others share; also in
    small blocks and without a broadcast."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr("ledgerlake.llm.common.FEW", most)
    rng = np.random.default_rng(3)
    base = [f"b{k}" for k in range(120)]
    passage = [f"p{k}" for k in range(60)]
    texts = []
    for i in range(120):
        w = list(base)
        for at in rng.choice(len(w), i % 9, replace=False):
            w[at] = f"e{i}.{at}"
        texts.append((1000 - i, " ".join(w)))
    for i in range(40):
        texts.append((2000 + i, " ".join(passage + [f"q{i}.{k}" for k in range(15 + i)])))
    for i in range(12):
        texts.append((3000 + i, " ".join(f"c{k}" for k in range(4 * i, 4 * i + 80))))
    assert near(docs(texts)) == brute_components(texts)


def test_near_dedup_rounds_do_not_write_tables_again(spark, docs, monkeypatch):
    """A crowd of near copies and others that its tables keep apart, in blocks of two: rows of tables are written a
    fixed number of times, not once for each round."""
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    written, real = Counter(), near_dedup.materialize

    def counted(df, name):
        out = real(df, name)
        written[name] += out.count()
        return out

    monkeypatch.setattr(near_dedup, "materialize", counted)
    rng = np.random.default_rng(7)
    texts = []
    for i in range(90):
        w = [f"b{k}" for k in range(120)]
        for at in rng.choice(len(w), i % 8, replace=False):
            w[at] = f"e{i % 30}.{at}"
        texts.append((i, " ".join(w)))
    assert near(docs(texts)) == brute_components(texts)
    assert written["open"] <= 3 * written["tables"] and written["pairs"] <= len(texts) ** 2 / 2


def test_only_others_meet_the_crowd_of_a_table(spark, monkeypatch):
    """Each pair of different components that can be linked, once; a table of one component brings none."""
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    sig = [0] * (2 * near_dedup.COLLECTION)
    members = [(1, r, 1 if r <= 20 else r, 100 if r != 22 else 50) for r in range(1, 25)] + [(2, r, 1, 100) for r in range(1, 9)]
    table = [(key, 0, rep, n, comp, 0, n, None, None, sig) for key, rep, comp, n in members]
    df = spark.createDataFrame(table, "key long, place short, rep long, n long, comp long, members long, shared long, common long, rare array<long>, sig array<int>")
    crowds = near_dedup._crowds(df)
    assert rows(crowds) == [(1, 1, 24)]
    got = Counter((r.a, r.b) for r in rows(near_dedup._apart(df, crowds)))
    assert got == Counter((a, b) for b in (21, 23, 24) for a in [*range(1, 21), 21, 23] if a < b)


def test_near_dedup_matches_brute_force_on_documents(spark):
    df = documents(spark, SF)
    assert near(df) == brute_components([(r.doc_id, r.text) for r in rows(df)])


@pytest.mark.parametrize("most", [200_000, 0])
def test_drop_near_copies_keeps_one_of_each_component(spark, docs, most, monkeypatch):
    """Repeated and null ids: one document of a component stays, whether what goes is broadcast or not."""
    monkeypatch.setattr("ledgerlake.llm.common.FEW", most)
    base, other = " ".join(f"w{k}" for k in range(60)), "quite another text of its own"
    texts = [(5, base), (5, base + " x"), (9, base + " y"), (None, base + " z"), (None, other), (3, "one two three four five six"), (3, "one two three four five six"), (7, ""), (7, None), (None, ""), (8, " \n"), (None, "a b"), (None, "a  b")]
    got = Counter((r.doc_id, r.text) for r in rows(near_dedup.drop_near_copies(docs(texts))))
    of_base, pair = [k for k in got if k[1] and k[1].startswith(base)], [k for k in got if k in ((None, "a b"), (None, "a  b"))]
    assert len(of_base) == 1 and of_base[0][0] == 5 and len(pair) == 1
    assert got - Counter(of_base + pair) == Counter([(None, other), (3, texts[5][1]), (3, texts[5][1]), (7, ""), (7, None), (None, ""), (8, " \n")])
    assert near_dedup.drop_near_copies(docs(texts)).columns == docs(texts).columns and rows(near_dedup.drop_near_copies(docs([]))) == []


def test_classes_that_share_a_name_get_others(spark):
    """Hashes that agree in their first 60 bits, as about 40 of 10**10 do."""
    clash = [bytes.fromhex("00112233445566" + f"{k:02x}" + "aa" * 8) for k in (0x70, 0x71, 0x7F)]
    df = spark.createDataFrame([(bytearray(x),) for x in [*clash, b"b" * 16, b"c" * 16]], "set_hash binary")
    names = {bytes(r.set_hash): r.rep for r in rows(near_dedup.class_names(df))}
    assert len(set(names.values())) == 5 and sorted(names[x] for x in clash) == [-3, -2, -1] and min(names[b"b" * 16], names[b"c" * 16]) > 0


def test_contract_joins_chains(spark):
    n = 40
    labels = spark.range(n).selectExpr("id as rep", "id as comp")
    links = spark.range(n - 1).selectExpr("id + 1 as a", "id as b").where("a <> 20")
    got = {r.rep: r.comp for r in rows(near_dedup.contract(labels, links)[0])}
    assert got == {i: 0 if i < 20 else 20 for i in range(n)}


# --- 5 mixing


def plain_raking(tokens, targets):
    """Cells {(source, lang, topic): tokens} scaled to each marginal in turn, as the textbook has it."""
    w = {c: float(n) for c, n in tokens.items() if n}
    for _ in range(400):
        for d in range(3):
            now = Counter()
            for c, x in w.items():
                now[c[d]] += x
            w = {c: x * targets[d][c[d]] / now[c[d]] for c, x in w.items()}
    return w


def flattened(tokens):
    out = []
    for d, power in enumerate(mixing.FLATTEN.values()):
        share = Counter()
        for c, n in tokens.items():
            share[c[d]] += n / sum(tokens.values())
        norm = sum(s**power for s in share.values() if s)
        out.append({v: s**power / norm for v, s in share.items() if s})
    return out


def test_mixing_is_raking(spark):
    """Weights as plain raking has them."""
    got = rows(mixing.mix(documents(spark, SF)))
    tokens = Counter()
    for r in got:
        tokens[(r.source, r.lang, r.topic)] += r.n_tokens
    want = plain_raking(tokens, flattened(tokens))
    for r in got:
        assert r.weight == pytest.approx(want.get((r.source, r.lang, r.topic), 0.0), rel=1e-5, abs=1e-12) and 0 <= r.probability <= 1


def test_both_fits_agree(spark, monkeypatch):
    """On the driver and by DataFrame steps, at one scale and with one rule to stop."""
    monkeypatch.setattr(mixing, "TOLERANCE", 1e-2)
    monkeypatch.setattr(mixing, "BOUND_TOLERANCE", 1e-2)
    df = documents(spark, SF).where("source in ('src0', 'src1', 'src2')")
    local, far = ({r.doc_id: r for r in rows(mixing.mix(df, keep=0.5, max_cells=n, targets={"source": {"src0": 1, "src1": 1, "src2": 1}}))} for n in (mixing.MAX_CELLS, 0))
    for i, r in local.items():
        assert (r.source, r.lang, r.topic, r.selected) == (far[i].source, far[i].lang, far[i].topic, far[i].selected)
        assert r.probability == pytest.approx(far[i].probability, rel=1e-6, abs=1e-12) and r.weight == pytest.approx(far[i].weight, rel=1e-6, abs=1e-12)


def test_mixing_meets_given_targets(spark):
    df = documents(spark, "/root/testdata/sf0.01").selectExpr("doc_id", "text", "lang", "if(doc_id % 3 = 0, 'hot', source) as source")
    targets = {"lang": {"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1, "nowhere": 3.0}, "source": {"hot": 0.25, **{f"src{i}": 0.75 / 20 for i in range(20)}}}
    mixed = mixing.mix(df, keep=0.4, targets=targets).cache()
    got = {(r.dimension, r.value): r for r in rows(mixing.marginals(mixed))}
    for d, own in targets.items():
        there = {v: t for v, t in own.items() if (d, v) in got and got[d, v].available > 0}
        for v, t in there.items():
            goal = t / sum(there.values())
            assert got[d, v].expected == pytest.approx(goal, rel=1e-3) and got[d, v].sampled == pytest.approx(goal, abs=0.06)
    assert all(r.expected == 0 for (d, v), r in got.items() if d == "lang" and v not in targets["lang"])
    assert {v for d, v in got if d == "topic"} <= {*map(str, range(mixing.TOPICS)), None}
    with pytest.raises(ValueError, match="lang"):
        mixing.mix(df, targets={"lang": {"nowhere": 1}}).collect()


def test_mixing_kept_tokens_meet_the_marginals(spark):
    hot = documents(spark, SF).selectExpr("doc_id", "text", "lang", "if(doc_id % 3 = 0, 'hot', source) as source")
    for df in (documents(spark, SF), hot):
        got = rows(mixing.mix(df))
        tokens = Counter()
        for r in got:
            tokens[(r.source, r.lang, r.topic)] += r.n_tokens
        goals, total, kept = flattened(tokens), sum(r.n_tokens for r in got), sum(r.n_tokens * r.probability for r in got)
        reach = 1.0
        for d, goal in enumerate(goals):
            has, now = Counter(), Counter()
            for r in got:
                has[r[d + 1]] += r.n_tokens / total
                now[r[d + 1]] += r.n_tokens * r.probability / kept
            for value, want in goal.items():
                assert now[value] == pytest.approx(want, abs=2e-4)
                reach = min(reach, has[value] / want)
        assert 0.7 * min(mixing.KEEP, reach) < kept / total < mixing.KEEP + 1e-3


def test_topics_come_from_the_whole_text(spark):
    """Against the definition word by word; the last words of texts that begin alike decide."""
    rng = np.random.default_rng(8)
    texts = {i: " ".join([f"c{x}" for x in rng.integers(0, 30, 40)] + [f"w{x}" for x in rng.integers(0, 90, 30)]) for i in range(200)} | {200: "", 201: None, 202: LONG}
    lang = {i: (None, "en", "de")[i % 3] for i in texts}
    df = spark.createDataFrame([(i, t, lang[i], "s") for i, t in texts.items()], "doc_id long, text string, lang string, source string")
    described, _ = mixing.describe(df)
    from pyspark.sql import functions as F

    slots = {r.lang: r.slot for r in rows(df.select("lang", mixing._slot(F.col("lang")).alias("slot")).distinct())}
    bucket = lambda w: (int(hashed([w.encode()])[0]) >> 20) % mixing.BUCKETS
    counts = Counter((slots[lang[i]], bucket(w)) for i, t in texts.items() for w in (t or "").split())
    total = {s_: sum(n for (x, _), n in counts.items() if x == s_) + mixing.BUCKETS for s_ in slots.values()}
    share = lambda s_, b: (counts[s_, b] + 1) / total[s_]
    usual = {s_: [sum(-math.log(share(s_, b)) * share(s_, b) for b in range(t, mixing.BUCKETS, mixing.TOPICS)) for t in range(mixing.TOPICS)] for s_ in slots.values()}
    want = {}
    for i, t in texts.items():
        s_, w = slots[lang[i]], (t or "").split()
        score = [-len(w) * u for u in usual[s_]]
        for x in w:
            score[bucket(x) % mixing.TOPICS] -= math.log(share(s_, bucket(x)))
        want[i] = f"={max(range(mixing.TOPICS), key=lambda k: score[k])}" if w else ""
    assert {r.doc_id: r.topic for r in rows(described)} == want and len(set(want.values())) > 3


def test_batches_are_cut_by_rows_and_bytes():
    from ledgerlake.llm import common

    texts = pa.array(["x" * n for n in (10, common.TEXT_BYTES + 5, 3, 4, common.TEXT_BYTES - 7, 1, 0)])
    batch = pa.RecordBatch.from_arrays([pa.array(range(9)).slice(1, 7), texts], names=["i", "t"])
    cut = [b.column(0).to_pylist() for b in common.chunks(iter([batch, batch.slice(5)]), 3)]
    assert cut == [[1], [2], [3, 4, 5], [6, 7], [6, 7]]
    assert [b.num_rows for b in common.chunks(iter([batch.select(["i"])]), 2)] == [2, 2, 2, 1]


def test_mixing_edge_cases(spark, docs):
    df = docs(EDGE)
    got = rows(mixing.mix(df))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGE) and {r.source for r in got} == {None}
    kept = mixing.sample_documents(df)
    assert kept.columns == df.columns and kept.count() == sum(r.selected for r in got)
    assert rows(mixing.mix(docs([]))) == [] and rows(mixing.sample_documents(docs([]))) == []
    assert rows(mixing.mix(docs([]), max_cells=-1)) == []


def test_mixing_columns_and_nulls(spark):
    """Other names, a topic column, clashing columns; null is not the text 'none'."""
    data = [(i, "a b c", "none" if i % 2 else None, "x" if i % 3 else "y", "t" if i % 5 else None, i) for i in range(120)]
    df = spark.createDataFrame(data, "id long, body string, site string, language string, subject string, probability int")
    names = dict(id_col="id", text_col="body", topic_col="subject", source_col="site", lang_col="language")
    got = rows(mixing.mix(df, keep=0.5, targets={"source": {None: 3, "none": 1}}, **names))
    kept = rows(mixing.sample_documents(df, keep=0.5, targets={"source": {None: 3, "none": 1}}, **names))
    assert {r.id for r in kept} == {r.doc_id for r in got if r.selected} and {r.source for r in got} == {None, "none"}
    expected = {s: sum(3 * r.probability for r in got if r.source == s) for s in (None, "none")}
    assert expected[None] / expected["none"] == pytest.approx(3, rel=1e-3)
    same_ = spark.createDataFrame([(1, "a", None, "en", "z")], "doc_id long, text string, source string, lang string, topic string")
    assert mixing.sample_documents(same_).columns == same_.columns


# --- 6 toxicity


def test_toxicity_learns_words_and_keeps_clean_rows(spark, docs):
    rng = np.random.default_rng(5)
    make = lambda i, bad: (i, " ".join([f"w{x}" for x in rng.integers(0, 400, 60)] + ["awful slur"] * bad))
    texts = [make(i, int(i % 5 == 0)) for i in range(600)]
    labelled = docs(texts[:400]).withColumn("toxic", (documents_column("doc_id") % 5 == 0).cast("int"))
    model = toxicity.fit(labelled)
    got = {r.doc_id: r for r in rows(toxicity.score_toxicity(docs(texts[400:] + EDGE[1:4]), model))}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    right = sum(got[i].predicted == (i % 5 == 0) for i, _ in texts[400:])
    assert right >= 195 and len(model.at) < 2000
    clean = toxicity.keep_clean(docs(texts[400:]), model)
    assert clean.columns == docs([]).columns and clean.count() == sum(not got[i].predicted for i, _ in texts[400:])


def brute_features(text):
    """Distinct features by plain integers: words, pairs, and pairs with a word left out."""
    full = (1 << 64) - 1

    def mixed(x):
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ x >> 33) * factor & full
        return (x ^ x >> 33) & (toxicity.DIMENSIONS - 1)

    h = [int(hashed([w])[0]) for w in (text or "").encode().lower().split()]
    p = 0x9E3779B97F4A7C15
    return {mixed(x + 1 & full) for x in h} | {mixed(a * p + b + 2 & full) for a, b in zip(h, h[1:])} | {mixed(a * p + b + 3 & full) for a, b in zip(h, h[2:])}


def test_toxicity_is_ftrl_proximal(spark, docs):
    """Against FTRL-proximal coordinate by coordinate in dicts: null, empty, repeated rows and a very long text among them."""
    from pyspark.sql import functions as F

    rng = np.random.default_rng(9)
    texts = [(i, " ".join([f"w{x}" for x in rng.integers(0, 30, 20)] + ["bad word"] * (i % 4 == 0))) for i in range(60)]
    texts += [(60, None), (61, ""), (6, texts[6][1]), (6, texts[6][1]), (62, LONG), (63, "w1 w2")]
    df = docs(texts).withColumn("toxic", F.when(documents_column("doc_id") != 63, (documents_column("doc_id") % 4 == 0).cast("int")))
    turn = {r.doc_id: r.t for r in rows(df.withColumn("t", F.xxhash64("doc_id", F.lit("turn"))))}
    sample = sorted(((turn[i], int(i % 4 == 0), np.array(sorted(brute_features(t)), "<u4").tobytes()) for i, t in texts if i != 63))
    features = [np.frombuffer(f, "<u4").tolist() for _, _, f in sample]
    seen = Counter(x for f in features for x in f)
    features = [[x for x in f if seen[x] >= toxicity.MIN_TEXTS] for f in features]
    labels = [y for _, y, _ in sample]
    heavy = ((len(labels) - sum(labels)) / sum(labels)) ** 0.5
    z, n, order = Counter(), Counter(), np.random.default_rng(7)

    def weight(x):
        if abs(z[x]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[x]) - z[x]) / ((toxicity.BETA + math.sqrt(n[x])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS[1]):
        for i in order.permutation(len(labels)):
            at = [*features[i], -1]
            w = {x: weight(x) for x in at}
            g = (heavy if labels[i] else 1.0) * (1 / (1 + math.exp(-sum(w.values()))) - labels[i])
            for x in at:
                z[x] += g - (math.sqrt(n[x] + g * g) - math.sqrt(n[x])) / toxicity.ALPHA * w[x]
                n[x] += g * g
    model = toxicity.fit(df)
    want = {x: weight(x) for x in z if x >= 0 and weight(x)}
    assert dict(zip(model.at.tolist(), model.weights)) == pytest.approx(want) and model.bias == pytest.approx(weight(-1))
    got = Counter((r.doc_id, round(r.score, 5)) for r in rows(toxicity.score_toxicity(df, model)))
    assert got == Counter((i, round(1 / (1 + math.exp(-weight(-1) - sum(want.get(x, 0.0) for x in brute_features(t)))), 5)) for i, t in texts)
    kept = toxicity.keep_clean(df, model)
    assert kept.columns == df.columns and kept.count() == sum(c for (_, s), c in got.items() if s < 0.5)


def documents_column(name):
    from pyspark.sql import functions as F

    return F.col(name)


def test_toxicity_without_labels_scores_a_half(spark, docs):
    empty = docs([]).withColumn("toxic", documents_column("doc_id").cast("int"))
    model = toxicity.fit(empty)
    assert {r.score for r in rows(toxicity.score_toxicity(docs(EDGE), model))} == {0.5}
    assert rows(toxicity.score_toxicity(docs([]), model)) == []


def test_toxicity_score_keeps_its_meaning_in_a_capped_sample(spark, docs):
    # nothing in the texts tells the labels apart, so the score is the prior: one in nine, weighed by the root of 8
    labelled = docs([(i, "one and the same") for i in range(900)]).withColumn("toxic", (documents_column("doc_id") % 9 == 0).cast("int"))
    score = lambda sample: rows(toxicity.score_toxicity(docs([(1, "one and the same")]), toxicity.fit(sample)))[0]
    whole, capped = score(labelled), toxicity.stratified(labelled, 100)
    counts = {r.toxic: r["count"] for r in rows(capped.groupBy("toxic").count())}
    assert counts[1] == 100 and 60 < counts[0] < 150
    assert score(capped).score == pytest.approx(whole.score, abs=0.06) and score(capped).predicted == whole.predicted == 0
    assert toxicity.stratified(labelled, 900).where("share < 1").count() == 0


# --- 7 winnowing


def brute_fingerprint(text):
    """(hash, position) pairs by a rolling hash, written for itself: token by token, window by window."""
    import xxhash

    ink = r"[^\x20\x09-\x0d]"
    tokens = [x for run in re.findall(f"{ink}+", text) for x in ([run] if len(run) <= 16 else run)]
    full = (1 << 64) - 1
    rot = lambda x, n: (x << n | x >> (64 - n)) & full if n else x
    h = [xxhash.xxh64(x.encode(), seed=42).intdigest() for x in tokens]
    if not h:
        return []
    if len(h) < 5:
        text = " ".join(str(x - (1 << 64) if x >> 63 else x) for x in h)
        return [(xxhash.xxh64(text.encode(), seed=42).intdigest() >> 25, 0)]
    now, grams = 0, []
    for i, x in enumerate(h):
        now = rot(now, 1) ^ x
        if i >= 5:
            now ^= rot(h[i - 5], 5)
        if i >= 4:
            grams.append((now >> 25, i - 4))
    out = []
    for s in range(max(1, len(grams) - 15)):
        best = min(grams[s : s + 16], key=lambda g: (g[0], -g[1]))
        if best not in out:
            out.append(best)
    return out


def brute_likeness(a, b):
    a, b = {h for h, _ in a}, {h for h, _ in b}
    return len(a & b) / len(a | b) if a | b else 1.0


def shown(pairs):
    return " ".join(f"{h:x}@{at}" for h, at in pairs)


def test_winnowing_windows(spark, docs):
    texts = [(i, " ".join(f"t{(i * 7 + k * k) % 50}" for k in range(n))) for i, n in enumerate([0, 1, 3, 5, 10, 20, 21, 60, 200])]
    texts += [(20 + i, t or "") for i, (_, t) in enumerate(EDGE)] + [(50, "same " * 100), (51, "中" * 90 + " x"), (52, "ß" * 16 + " " + "ß" * 17)]
    got = {r.doc_id: r.f for r in rows(docs(texts).select("doc_id", winnowing.readable(winnowing.fingerprint(documents_column("text"))).alias("f")))}
    assert got == {i: shown(brute_fingerprint(t)) for i, t in texts}


def test_shared_passage_shares_a_hash(spark, docs):
    passage = " ".join(f"s{k}" for k in range(winnowing.GRAM + winnowing.WINDOW - 1))
    texts = [(i, " ".join(f"x{i}.{k}" for k in range(5 + 3 * i)) + " " + passage + " " + " ".join(f"y{i}.{k}" for k in range(30))) for i in range(20)]
    sets = [set(r.h) for r in rows(docs(texts).select(winnowing.hashes(winnowing.fingerprint(documents_column("text"))).alias("h")))]
    assert all(a & b for a in sets for b in sets)


def test_long_runs_are_hashed_at_every_offset(spark, docs):
    rng = np.random.default_rng(3)
    run = lambda n: "".join(chr(0x4E00 + x) for x in rng.integers(0, 5000, n))
    passage = run(winnowing.GRAM + winnowing.WINDOW - 1)
    texts = [(i, run(40 + i) + passage + run(40)) for i in range(20)]
    sets = [set(r.h) for r in rows(docs(texts).select(winnowing.hashes(winnowing.fingerprint(documents_column("text"))).alias("h")))]
    assert all(a & b for a in sets for b in sets)
    mixed = [(1, "a " + "b" * winnowing.TOKEN + "\t" + "c" * winnowing.TOKEN + "de 😀😀 " + "😀" * 17)]
    want = ["a", "b" * winnowing.TOKEN, *"c" * winnowing.TOKEN, "d", "e", "😀😀", *"😀" * 17]
    assert list(rows(docs(mixed).select(winnowing.tokens(documents_column("text")).alias("t")))[0].t) == want


def test_winnowing_query(spark):
    """All columns by brute force, on the smallest table."""
    got = sorted(rows(winnowing.op7_winnowing(spark, SF)), key=lambda r: r.doc_id)
    texts = {r.doc_id: r.text or "" for r in rows(documents(spark, SF))}
    ids = sorted(texts)
    prints = {i: brute_fingerprint(texts[i]) for i in ids}
    assert [r.doc_id for r in got] == ids
    for k, r in enumerate(got):
        follower = ids[(k + 1) % len(ids)]
        t, tail = texts[r.doc_id], len(texts[r.doc_id]) // 2
        changed = t[: len(t) - tail] + texts[follower][:tail]
        assert r.n_chars == len(t) and r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == shown(prints[r.doc_id]) and r.edited_fingerprint == shown(brute_fingerprint(changed))
        assert r.near_edited == pytest.approx(brute_likeness(prints[r.doc_id], brute_fingerprint(changed)))
        assert r.near_next == pytest.approx(brute_likeness(prints[r.doc_id], prints[follower]))


def test_winnowing_of_an_empty_table(spark, tmp_path):
    documents(spark, SF).limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert rows(winnowing.op7_winnowing(spark, str(tmp_path))) == []


@pytest.mark.parametrize("ids", [[1], [5, 5, 5], [None, None, 3], [-(1 << 62), 0, 1, 2, 1 << 62], list(range(0, 3000, 7)), [*range(100), *(10**15 + 3 * k for k in range(100))]])
def test_with_next_is_a_ring(spark, docs, ids):
    from pyspark.sql import functions as F

    df = docs([(i, f"t{k}") for k, i in enumerate(ids)]).select("doc_id", "text")
    data = [(r.doc_id, r.h, r.text) for r in rows(df.withColumn("h", F.xxhash64("text")))]
    order = sorted(data, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = Counter((a[0], a[2], b[2]) for a, b in zip(order, order[1:] + order[:1]))
    for size in (1, 16, 256):
        assert Counter((r.doc_id, r.text, r.next_text) for r in rows(winnowing.with_next(df, ["text"], size=size))) == want


# --- 8 hidden Markov model


def test_hmm_counts_base_score_and_gain(spark):
    df = documents(spark, SF)
    got = rows(hmm_score.op8_hmm_score(spark, SF))
    texts = {r.doc_id: (r.text or "").encode().lower().split() for r in rows(df)}
    train = Counter()
    for i, w in texts.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            train.update([*w, None])
    n, v = train.total(), len(train)
    for r in got:
        t = [*texts[r.doc_id], None]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(t), sum(train[x] > 0 for x in t), n, zlib.crc32(str(r.doc_id).encode()) % 5 == 1)
        assert r.base_score == pytest.approx(sum(math.log10((train[x] + 0.5) / (n + 0.5 * (v + 1))) for x in t))
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def test_small_broadcast_gives_the_same_base_score(spark, docs):
    texts = [(i, " ".join(f"w{(i * k) % 13}" for k in range(i + 2))) for i in range(30)]
    out = documents_column("doc_id") % 3 == 0
    a, b = ({r.doc_id: r for r in rows(hmm_score.hmm_scores(docs(texts), out, states=2, iterations=1, counted=c))} for c in (1 << 10, 2))
    for i, r in a.items():
        assert (r.n_known, r.n_tokens) == (b[i].n_known, b[i].n_tokens) and r.base_score == pytest.approx(b[i].base_score)


def small_model():
    rng = np.random.default_rng(0)
    emit = rng.uniform(0.1, 1, (4, 3))
    move = rng.uniform(0.1, 1, (3, 3))
    return hmm_score.Hmm(np.array([0.5, 0.3, 0.2]), move / move.sum(1, keepdims=True), emit / emit.sum(0))


def brute_likelihood(m, s):
    import itertools

    return sum(m.start[q[0]] * m.emit[s[0], q[0]] * math.prod(m.move[a, b] * m.emit[x, b] for a, b, x in zip(q, q[1:], s[1:])) for q in itertools.product(range(3), repeat=len(s)))


def test_forward_recursion_is_exact():
    m, seqs = small_model(), [np.array(s) for s in ([0], [1, 2], [3, 0, 1, 1], [2, 2, 0, 3, 1, 0])]
    assert hmm_score.log10_likelihoods(m, seqs) == pytest.approx([math.log10(brute_likelihood(m, s)) for s in seqs])


def brute_counts(m, s):
    import itertools

    start, move, emit, whole = np.zeros(3), np.zeros((3, 3)), np.zeros((4, 3)), 0.0
    for q in itertools.product(range(3), repeat=len(s)):
        p = m.start[q[0]] * m.emit[s[0], q[0]] * math.prod(m.move[a, b] * m.emit[x, b] for a, b, x in zip(q, q[1:], s[1:]))
        whole += p
        start[q[0]] += p
        for a, b in zip(q, q[1:]):
            move[a, b] += p
        for x, k in zip(s, q):
            emit[x, k] += p
    return start / whole, move / whole, emit / whole, math.log(whole)


@pytest.mark.parametrize("tokens", [1, 3, 7, 1 << 17])
def test_expected_counts_of_whole_sequences_are_exact(tokens):
    """Also of sequences longer than the piece whose messages are held."""
    m, seqs = small_model(), [np.array(s) for s in ([0], [1, 2], [3, 0, 1, 1, 2, 3, 0], [2, 2, 0, 3, 1, 0], [1, 2, 3, 0, 1, 2, 2, 1, 0], [1, 1])]
    counts = hmm_score.Counts(3, 4)
    hmm_score.expected_counts(m, seqs, counts, tokens)
    want = [sum(x) for x in zip(*(brute_counts(m, s) for s in seqs))]
    for got, exact in zip((counts.start, counts.move, counts.emit, counts.likelihood), want):
        assert got == pytest.approx(exact)
    assert hmm_score.log10_likelihoods(m, seqs, tokens) == pytest.approx([math.log10(brute_likelihood(m, s)) for s in seqs])


def test_long_sequences_do_not_underflow():
    m, s = small_model(), np.random.default_rng(4).integers(0, 4, 30_000)
    counts = hmm_score.Counts(3, 4)
    hmm_score.expected_counts(m, [s, s[:5]], counts, 1000)
    assert counts.start.sum() == pytest.approx(2) and counts.move.sum() == pytest.approx(30_003) and counts.emit.sum() == pytest.approx(30_005)
    now, total = m.start, 0.0
    for t, x in enumerate(s):
        now = (now @ m.move if t else now) * m.emit[x]
        total += math.log10(now.sum())
        now = now / now.sum()
    assert hmm_score.log10_likelihoods(m, [s], 1000)[0] == pytest.approx(total)


def test_model_is_a_distribution_and_em_climbs():
    m = small_model()
    assert sum(brute_likelihood(m, s) for s in ((a, b) for a in range(4) for b in range(4))) == pytest.approx(1)
    seqs = list(np.random.default_rng(1).integers(0, 4, (50, 8)))
    last = -math.inf
    for _ in range(6):
        c = hmm_score.Counts(3, 4)
        hmm_score.expected_counts(m, seqs, c)
        assert c.likelihood >= last - 1e-9 and c.start.sum() == pytest.approx(50) and c.emit.sum() == pytest.approx(400) and c.move.sum() == pytest.approx(350)
        last, m = c.likelihood, hmm_score.Hmm(c.start / c.start.sum(), c.move / c.move.sum(1, keepdims=True), c.emit / c.emit.sum(0))


def test_hmm_score_is_the_likelihood_of_the_words(spark, docs):
    """From the trained model and plain counts: a word's chance is its symbol's in the chain, shared out inside the rare symbol."""
    texts = [(i, " ".join(f"w{(i * k * k) % 29}" for k in range(i % 11))) for i in range(80)] + [(90, "never seen w1 w1"), (91, None)]
    df, out = docs(texts), documents_column("doc_id") % 4 == 0
    rows_of = df.select("doc_id", out.alias("held_out"), "text")
    for counted in (1 << 10, 6):
        lexicon, model, _, _ = hmm_score.model_of(rows_of, 3, 2, 9, counted)
        train = Counter(x for i, t in texts if i % 4 for x in [*(t or "").split(), None])
        hashes = {x: hmm_score.END_HASH if x is None else int(hashed([x.encode()]).view(np.int64)[0]) for x in {*train, "never", "seen"}}
        symbol = {h: int(s) for h, s in zip(lexicon.hashes, lexicon.symbols)}
        of = {x: symbol.get(h, hmm_score.RARE) for x, h in hashes.items()}
        rare = sum(c for x, c in train.items() if of[x] == hmm_score.RARE) + 0.5 * (sum(of[x] == hmm_score.RARE for x in train) + 1)
        got = {r.doc_id: r.score for r in rows(hmm_score.hmm_scores(df, out, states=3, iterations=2, symbols=9, counted=counted))}
        for i, t in texts:
            w = [*(t or "").split(), None]
            now = None
            want = 0.0
            for x in w:
                now = (model.start if now is None else now @ model.move) * model.emit[of[x]]
                want += math.log10(now.sum()) + (math.log10((train[x] + 0.5) / rare) if of[x] == hmm_score.RARE else 0)
                now = now / now.sum()
            assert got[i] == pytest.approx(want, rel=1e-5)


def test_most_frequent_takes_part_of_a_step_that_is_too_large(spark):
    counts = spark.range(5000).selectExpr("id as word", "if(id < 10, 50, 1) as c")
    got = {r.word for r in rows(hmm_score.most_frequent(counts, 1000))}
    assert set(range(10)) <= got and 900 < len(got) < 1100
    assert hmm_score.most_frequent(counts, 6000).count() == 5000 and 0 <= hmm_score.most_frequent(counts, 4).count() <= 10


def test_counting_hands_on_when_full(spark, docs):
    texts = [(i, " ".join(f"w{(i * k) % 37}" for k in range(20))) for i in range(30)]
    whole = Counter((r.word, r.c) for r in rows(hmm_score.count_words(docs(texts).select("text"))))
    assert Counter((r.word, r.c) for r in rows(hmm_score.count_words(docs(texts).select("text"), flush=3))) == whole


def test_hmm_edge_cases(spark, docs):
    out = documents_column("doc_id").eqNullSafe(7)
    got = rows(hmm_score.hmm_scores(docs(EDGE), out, states=2, iterations=1))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in EDGE) and all(r.score < 0 and r.base_score < 0 for r in got)
    nothing = rows(hmm_score.hmm_scores(docs(EDGE), documents_column("text").isNull() | documents_column("text").isNotNull(), states=2, iterations=1))
    assert len(nothing) == len(EDGE) and all(r.n_known == 0 and r.train_tokens == 0 for r in nothing)
    assert rows(hmm_score.hmm_scores(docs([]), out, states=2, iterations=1)) == []


# --- 9 language id


def test_language_id_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in rows(documents(spark, "/root/testdata/sf0.01"))}
    got = [r for r in rows(language_id.op9_language_id(spark, "/root/testdata/sf0.01")) if r.held_out and truth[r.doc_id]]
    assert sum(r.lang_pred == truth[r.doc_id] for r in got) / len(got) > 0.97


def test_language_id_edge_cases(spark, docs):
    train = docs([(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "en"), ("", "de")] * 5)])
    model = language_id.fit(train)
    got = {(r.doc_id, r.lang_pred) for r in rows(language_id.identify(docs([(1, "the dog"), (2, "die katze"), (3, None), (4, "123 !!"), (None, "und der"), (5, "x" * 100_000)]), model))}
    assert {(1, "en"), (2, "de"), (3, "und"), (4, "und"), (None, "de")} <= got and len(got) == 6
    none = language_id.fit(docs([]).where("lang is not null"))
    assert {r.lang_pred for r in rows(language_id.identify(docs(EDGE), none))} == {"und"}
    assert rows(language_id.identify(docs([]), model)) == []


def brute_languages(train, texts):
    """Plain naive Bayes, gram by gram, with the operator's hash of a gram."""

    def grams(text):
        out = Counter()
        for w in language_id.tokens(text or ""):
            for _, buckets in language_id.ngrams([w]):
                out.update(buckets.tolist())
        return out

    counts, docs = {}, Counter(lang for _, lang in train)
    for t, lang in train:
        counts.setdefault(lang, Counter()).update(grams(t))
    out = {}
    for i, t in texts:
        n = len(language_id.tokens(t or ""))
        if not n or not counts:
            out[i] = ("und", 0.0)
            continue
        found, prior = {}, {k: math.log((docs[k] + 1) / (sum(docs.values()) + len(docs))) for k in counts}
        for lang, c in counts.items():
            norm = c.total() + language_id.SMOOTHING * language_id.BUCKETS
            found[lang] = sum(k * math.log((c[b] + language_id.SMOOTHING) / norm) for b, k in grams(t).items())
        best = max(sorted(found), key=lambda k: found[k] + prior[k])
        logit = {k: prior[k] + v / (1 + n / language_id.TEMPER) for k, v in found.items()}
        top = max(logit.values())
        out[i] = (best, math.exp(logit[best] - top) / sum(math.exp(x - top) for x in logit.values()))
    return out


@pytest.mark.parametrize("size", [128, 2, 1])
def test_language_id_is_naive_bayes(spark, docs, size):
    """Against plain naive Bayes, with all labels at once and with more labels than a block has."""
    table = [(r.doc_id, r.text, r.lang) for r in rows(documents(spark, SF)) if r.text]
    train = [(t, lang) for _, t, lang in table[:60]] + [("zz yy", "zu"), ("", "aa"), (None, "en")]
    texts = [(i, t) for i, t, _ in table[60:110]] + [(1000, None), (1001, "42 !"), (1002, "zz"), (1003, "Ünï Σς")]
    model = language_id.fit(docs([(i, t, lang) for i, (t, lang) in enumerate(train)]).where("lang is not null"), size)
    got = {r.doc_id: (r.lang_pred, r.score) for r in rows(language_id.identify(docs(texts), model))}
    want = brute_languages([x for x in train if x[1]], texts)
    for i, (lang, score) in want.items():
        assert got[i][0] == lang and got[i][1] == pytest.approx(score, abs=1e-3)


def test_language_id_with_many_labels(spark, docs):
    words = [f"{chr(97 + i // 26)}{chr(97 + i % 26)}" * 3 for i in range(450)]
    model = language_id.fit(docs([(i, f"{w} {w}", f"l{i:03d}") for i, w in enumerate(words)]))
    assert len(model.languages) == 450 > model.size
    got = {r.doc_id: r.lang_pred for r in rows(language_id.identify(docs([(i, w) for i, w in enumerate(words)]), model))}
    assert sum(got[i] == f"l{i:03d}" for i in got) > 445


# --- 10 token counts


def brute_segmentation(v, word):
    text = token_counts.MARK + word
    best = [(0.0, 0)]
    for end in range(1, len(text) + 1):
        n = len(text[end - 1].encode())
        options = [(best[end - 1][0] + v.floor * n, best[end - 1][1] + n)]
        options += [(best[s][0] + v.scores[text[s:end]], best[s][1] + 1) for s in range(end - 1, -1, -1) if text[s:end] in v.scores]
        top = options[0]
        for o in options[1:]:
            if o[0] >= top[0]:
                top = o
        best.append(top)
    return best[-1][1], best[-1][0]


@given(st.text(alphabet="abcß中", min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_trie_scores_are_viterbi(word):
    v = token_counts.Vocabulary({"▁": -1.0, "▁a": -1.5, "a": -2.0, "b": -2.0, "ab": -3.0, "abc": -3.5, "c": -4.0, "bc": -2.5, "▁ab": -3.2})
    shared = token_counts.Trie(v)
    shared.count("abca")
    got = shared.count(word)
    want = brute_segmentation(v, word)
    assert got[0] == want[0] and got[1] == pytest.approx(want[1])


def test_token_counts_edge_cases(spark, docs, monkeypatch):
    path = public_tokenizers.path("piece_bpe_32k.model")
    v = token_counts.Vocabulary.from_file(path)
    got = Counter((r.doc_id, r.n_tokens, r.n_pretokens) for r in rows(token_counts.count_tokens(docs(EDGE), path)))
    cut = {t: re.findall(r"[^\x20\x09-\x0d]+", t or "") for _, t in EDGE}
    want = Counter((i, sum(brute_segmentation(v, w)[0] for w in cut[t]), len(cut[t])) for i, t in EDGE)
    assert got == want
    assert rows(token_counts.count_tokens(docs([]), path)) == []
