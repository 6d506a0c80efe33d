"""Spelling variants, packing and collocations against brute force: nulls, empties, long texts, ties, repeats, clashing columns."""

import collections
import random
import re
import sys
import zlib
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from chronoloom.llm import collocation, lm, mixing, packing, spelling
from tests.llm.test_operators import SCHEMA, odd_rows


def spoken(seed, rows, words, ids=True):
    rng = random.Random(seed)
    return [((i if ids else None), " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))), rng.choice(["en", "fr", None]), "s", 1, 2, 3, "k") for i in range(rows)]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# ---- spelling variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(rows):
    total = collections.Counter()
    for r in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", r[1] or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if r[0] is None else r[0]}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            total[w] += 1
    words = {w: n for w, n in total.items() if len(w) >= 5 and n >= 3}
    found, form = {}, {}
    for w, n in words.items():
        close = [x for x in words if near(w, x)]
        best = min(close, key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best
        found[w] = len(close)
    out = []
    for w, n in words.items():
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n, found[w], words[form[w]] if w in form else None))
    return sorted(out)


def variant_rows():
    rng = random.Random(3)
    stems = ["banana", "élève", "straße", "letter", "aaaaaa", "thing×", "x" * 40]
    words = list(stems)
    for s in stems:
        for _ in range(12):
            i = rng.randrange(len(s) + 1)
            words += [s[:i] + rng.choice("abeé") + s[i:], s[:i] + rng.choice("abeé") + s[i + 1 :], s[:i] + s[i + 1 :]]
    words += ["".join(rng.choice("ab") for _ in range(rng.choice([5, 6, 7]))) for _ in range(150)]  # many anagrams share signatures
    rows = spoken(5, 120, words + stems * 20) + spoken(6, 3, words, ids=False)
    return [*rows, *odd_rows(), (7, "Banana" * 20_000 + " BANANA", None, None, 1, 1, 1, "x")]


@pytest.mark.parametrize("group_rows", [50_000, 3])
def test_spelling_variants(spark, empty, group_rows):
    rows = variant_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = spelling.spelling_variants(docs, group_rows=group_rows)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert sorted(tuple(r) for r in got.collect()) == brute_variants(rows)
    assert spelling.spelling_variants(empty).count() == 0


def test_signatures_lose_no_near_pair():
    dealt = spelling.Seats({(97, 0): 5, (98, 0): 4, (97, 1): 3})
    rng = random.Random(1)
    for _ in range(300):
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(5, 9)))
        i = rng.randrange(len(a))
        b = rng.choice([a[:i] + rng.choice("abcé") + a[i + 1 :], a[:i] + a[i + 1 :], a[:i] + rng.choice("abcé") + a[i:]])
        if a == b:
            continue
        dims = [collections.Counter(spelling._dimensions(spelling._matrix([w]))[0].tolist()) for w in (a, b)]
        seats = {int(dealt.of(np.array([d], np.uint64))[0]) for d in (dims[0] - dims[1]) + (dims[1] - dims[0])}
        assert any(seats <= set(p) for p in spelling.PAIRS) if len(a) == len(b) else len(seats) == 1


# ---- packing


def tokenizer():
    return packing.read_tokenizer()


@pytest.mark.parametrize("pool_tokens", [1 << 20, 3000])
def test_packing(spark, empty, pool_tokens):
    from tokenizers import Tokenizer

    rows = [*odd_rows(), *spoken(9, 80, ["alpha", "beta!", "Gamma"]), (None, "tail", None, None, 1, 1, 1, "y")]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = packing.packed_pieces(docs, tokenizer(), pool_tokens=pool_tokens).collect()
    known, found = Tokenizer.from_str(tokenizer()), collections.Counter()
    want = collections.Counter((r[0], tuple([*known.encode(r[1] or "", add_special_tokens=False).ids, 1])) for r in rows)
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        by_doc[r["doc_id"], r["doc_tokens"]].append((r["start"], ids))
        by_sequence[r["sequence_id"]].append((r["offset"], len(ids), r["tier"], r["step_id"]))
    for (doc, n), pieces in by_doc.items():
        copies = sum(c for (d, ids), c in want.items() if d == doc and len(ids) == n)
        assert sum(len(ids) for _, ids in pieces) == n * copies
        if copies == 1:
            joined = np.concatenate([ids for _, ids in sorted(pieces, key=lambda p: p[0])])
            assert [p[0] for p in sorted(pieces, key=lambda p: p[0])] == np.cumsum([0] + [len(ids) for _, ids in sorted(pieces, key=lambda p: p[0])])[:-1].tolist()
            found[doc, tuple(joined.tolist())] += 1
    assert all(want[k] >= c for k, c in found.items()) and len(found) > 50
    not_full = 0
    for pieces in by_sequence.values():
        pieces.sort()
        assert [p[0] for p in pieces] == np.cumsum([0] + [p[1] for p in pieces])[:-1].tolist()
        assert len({p[2:] for p in pieces}) == 1
        not_full += sum(p[1] for p in pieces) != pieces[0][2]
    assert not_full <= 1
    assert packing.packed_pieces(empty, tokenizer()).count() == 0


def test_gaps_take_whole_shorter_documents_and_steps_are_balanced():
    packer = packing.Packer((8, 16, 32), 64, 0)
    for i, n in enumerate([20, 12, 20, 9, 3, 5, 7, 32, 64]):
        packer.add(i, 0, n, np.arange(n, dtype="<u4"))
    packer.pack(True)
    by_sequence = collections.defaultdict(list)
    for doc, start, total, ids, sequence, *_ in packer.done:
        by_sequence[sequence].append((doc, len(ids) // 4, total))
    assert [(0, 20, 20), (1, 12, 12)] in by_sequence.values()  # the gap of 12 takes the document of 12, uncut
    assert sum(n for s in by_sequence.values() for _, n, _ in s) + packer.tokens == 172
    waits = [[packing.Rest(n, 0, 0, 0, n, np.zeros(n, "<u4"))] for n in (1, 30, 2, 29)]
    packer.done, packer.waiting[32] = [], waits
    packer._steps(32, True)
    costs = collections.Counter()
    for row in packer.done:
        costs[row[7]] += (len(row[3]) // 4) ** 2
    assert max(costs.values()) - min(costs.values()) < 100


# ---- collocations


def brute_collocations(rows, least, first, percent):
    f, totals = collections.Counter(), collections.Counter()
    for r in rows:
        lang = r[2] or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), r[1] or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, 5):
                f.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {key: a for key, a in f.items() if len(key[1]) >= 2 and a >= least}
    longer = collections.Counter()
    for (lang, ws), a in found.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                longer[lang, ws[i : i + k]] = max(longer[lang, ws[i : i + k]], a)
    out = collections.defaultdict(list)
    for (lang, ws), a in found.items():
        if 100 * longer[lang, ws] >= percent * a and longer[lang, ws]:
            continue
        score, k = min((2000000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k) for k in range(1, len(ws)))
        out[lang].append((-score, -a, " ".join(ws).encode(), f[lang, ws[:k]], f[lang, ws[k:]]))
    return sorted((lang, i, p.decode(), -a, left, right, totals[lang], -s) for lang, x in out.items() for i, (s, a, p, left, right) in enumerate(sorted(x)[:first], 1))


@pytest.mark.parametrize("slice_phrases", [400_000, 60])
def test_collocations(spark, empty, slice_phrases):
    rows = [*odd_rows(), *spoken(2, 90, ["of", "the", "New", "York", "über x", "a.b", "tick, tock", "\t漢字", "the of", "x" * 3000])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = collocation.collocations(docs, least=4, first=60, slice_phrases=slice_phrases)
    assert sorted(tuple(r) for r in got.collect()) == brute_collocations(rows, 4, 60, 80)
    if slice_phrases > 60:
        assert collocation.collocations(empty).count() == 0


def test_many_slices_take_few_passes(spark, monkeypatch):
    rows = [*odd_rows(), *spoken(2, 90, ["of", "the", "New", "York", "über x", "a.b", "tick, tock", "\t漢字", "the of", "x" * 3000])]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    passes = []
    for name in ("_counted", "_proposed", "_accepted"):
        plain = getattr(collocation, name)
        monkeypatch.setattr(collocation, name, lambda *a, _name=name, _plain=plain: passes.append(_name) or _plain(*a))
    found, _ = collocation.candidates(docs, least=4, slice_phrases=40)
    n = found.count()
    assert n > 4 * 40 and passes.count("_accepted") == 0 and passes.count("_proposed") <= 2 + -(-n // 80)
    whole, _ = collocation.candidates(docs, least=4)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, whole.collect())) and passes.count("_accepted") == 1


def test_large_counts_are_exact(spark):
    big = 10**15
    found = spark.createDataFrame([("en", "a b", 2, big)], "lang string, phrase string, words int, a long")
    words = spark.createDataFrame([("en", "a", big + 1), ("en", "b", big + 2), ("en", None, 5 * big)], "lang string, word string, n long")
    assert collocation.scored(found, words).first()["score"] == 2000000 * big // (2 * big + 3)


def test_words_and_proposals_are_counted_in_arrays(monkeypatch):
    """Few rows for many texts, in batches of bounded size, and no Python call a word."""
    rows = [" ".join(f"w{i * j % 7919}" for j in range(1, 400)) for i in range(1, 120)]
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * len(rows)), pa.array(rows)], names=["lang", "text"])
    monkeypatch.setattr(collocation, "chunks", lambda offsets: ((a, a + 1) for a in range(len(offsets) - 1)))
    want = collections.Counter(w for r in rows for w in r.split())
    calls = 0

    def count(frame, event, _):
        nonlocal calls
        calls += event == "call" and frame.f_code.co_filename == collocation.__file__

    for held in (250_000, 500):  # with the small one, words are told several times
        monkeypatch.setattr(collocation, "HELD_WORDS", held)
        calls = 0
        sys.setprofile(count)
        try:
            told = list(collocation._counted(0)(iter([batch])))
        finally:
            sys.setprofile(None)
        got, totals = collections.Counter(), 0
        for r in pa.Table.from_batches(told).to_pylist():
            if r["word"] is None:
                totals += r["n"]
            else:
                got[r["word"]] += r["n"]
        assert got == want and totals == sum(want.values())
        assert calls < 20 * len(rows) < len(want)
    sums = {}
    words = np.unique(np.concatenate([f.hashes for f, _ in collocation._texts(iter([batch]), 0)]))
    trie = collocation.Trie([[int(w)] for w in words], words.view(np.int64))
    for held in (2_400_000, 300):
        monkeypatch.setattr(collocation, "HELD_PROPOSALS", held)
        for whole in (True, False):
            told = pa.Table.from_batches(collocation._proposed(SimpleNamespace(value=trie), 1, whole, 10**6, 0)(iter([batch]))).to_pylist()
            sums[held, whole] = collections.Counter()
            for r in told:
                sums[held, whole][r["prefix"], r["next"]] += r["seen"]
    assert len({frozenset(c.items()) for c in sums.values()}) == 1 and sum(sums[300, True].values()) == sum(len(r.split()) - 1 for r in rows)


@pytest.mark.parametrize("size", [1 << 14, 7])
def test_one_pass_counts_with_two_tries(monkeypatch, size):
    monkeypatch.setattr(collocation, "RANGE", size)
    rng = random.Random(6)
    batch = pa.RecordBatch.from_arrays([pa.array(["en"] * 40), pa.array([" ".join(rng.choice("abcdefgh") for _ in range(60)) for _ in range(40)])], names=["lang", "text"])
    hashes = {w: int(found.hashes[list("abcdefgh").index(w)]) for found, _ in collocation._texts(iter([pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array(["a b c d e f g h"])], names=["lang", "text"])]), 0) for w in "abcdefgh"}
    paths = sorted({tuple(rng.choice("abcdefgh") for _ in range(rng.randint(2, 3))) for _ in range(60)})
    made = [SimpleNamespace(value=collocation.Trie([[hashes[w] for w in paths[i]] for i in own], np.array(own))) for own in (list(range(0, len(paths), 2)), list(range(1, len(paths), 2)))]
    told = list(collocation._accepted(made, 0)(iter([batch])))
    assert sum(map(len, told)) <= sum(-(-len(m.value.keys) // size) for m in made)  # not a row a phrase
    twice = pa.Table.from_batches(told + told).sort_by([("trie", "ascending"), ("range", "ascending")]).to_batches()
    got = {r["key"]: r["a"] // 2 for r in pa.Table.from_batches(list(collocation._summed(made)(iter(twice)))).to_pylist()}
    want = collections.Counter(" ".join(t[i : i + k]) for t in (t.split() for t in batch.column(1).to_pylist()) for k in (2, 3) for i in range(len(t) - k + 1))
    assert got == {i: want[" ".join(p)] for i, p in enumerate(paths) if want[" ".join(p)]}


def test_trie_counts_like_a_dictionary():
    rng = random.Random(4)
    paths = sorted({tuple(rng.randrange(2**63) % 40 + 1 for _ in range(rng.randint(2, 4))) for _ in range(500)})
    trie = collocation.Trie([list(p) for p in paths], np.arange(len(paths)))
    text = np.array([rng.randrange(45) for _ in range(5000)], np.uint64)
    goes_on = np.array([rng.random() > 0.1 for _ in text])
    got = collections.Counter()
    for _, states in trie.advance(trie.labels(text), goes_on):
        got.update(paths[i] for i in trie.accept[states] if i >= 0)
    known = set(paths)
    spans = (tuple(text[i : i + k].tolist()) for k in range(2, 5) for i in range(len(text) - k + 1) if goes_on[i + 1 : i + k].all())
    want = collections.Counter(s for s in spans if s in known)
    assert got == want


# ---- mixing: no shuffle of documents on their source


def test_targets_meet_documents_without_a_shuffle_on_source(spark):
    rows = [(i, "word " * (i % 5), "hot" if i % 2 else f"s{i % 7}" if i % 6 else None) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    sized = docs.select("doc_id", "source", mixing.n_words("text").alias("size"))
    targets = mixing.source_targets(sized.select("source", "size"))
    plain, salted = (mixing.with_targets(sized, targets, most) for most in (50_000, 0))
    key = lambda df: sorted(map(str, df.select("doc_id", "source", "size", "source_size", "target").collect()))
    assert key(plain) == key(salted) and plain.count() == 400
    told = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in told(plain) and "hashpartitioning(coalesce(source" not in told(plain)


# ---- language model: counts beyond 32 bits


def test_counts_beyond_32_bits():
    import pyarrow as pa

    words = np.array([3, 9], np.uint64).tobytes()
    rows = [(0, block, words, np.array([2**31, block], np.uint32).tobytes()) for block in (1, 2, 3)]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), [pa.int32(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["part", "block", "words", "counts"])
    out = [r for b in lm._answer([batch]) for r in b.to_pylist()]
    assert [r["n"] for r in out if r["block"] is None] == [3 * 2**31 + 6]
    assert all(lm._wide(r["counts"]).tolist() == [3 * 2**31, 6] for r in out if r["block"])
    assert lm._narrow(np.array([5])) == b"\x04\x05\0\0\0" and lm._wide(lm._narrow(np.array([2**40]))).tolist() == [2**40]


def test_spelling_memory_of_a_worker_does_not_grow_with_its_rows():
    """Words are counted and compared a bounded number at a time, and an idle worker holds none of them."""
    import gc
    import weakref

    import numpy as np
    import pyarrow as pa

    class Held:
        value = spelling.Seats({})

    words = sorted({f"{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}lantern" for i in range(3000)})
    rows = pa.RecordBatch.from_arrays([pa.array(words), pa.array([1] * len(words), pa.int64())], names=["word", "n"])
    table = pa.Table.from_batches(list(spelling._signatures(Held, np.empty(0, np.uint64))(iter([rows])))).sort_by([("sig", "ascending"), ("side", "ascending")])
    made, alive = [], []
    kept = spelling._Rows.__init__

    def watched(self, part):
        kept(self, part)
        made.append(sum(self.lengths))
        alive.append(weakref.ref(self))

    given = []
    spelling._Rows.__init__ = watched
    release, spelling.release = spelling.release, lambda: (gc.collect(), given.append(sum(r() is not None for r in alive)))
    try:
        near = {}
        for batch in spelling._near_words(Held)(iter(table.combine_chunks().to_batches(500))):
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                near[word] = near.get(word, 0) + n
    finally:
        spelling._Rows.__init__, spelling.release = kept, release
    assert given and given[-1] == 0  # nothing is held when memory is given back
    assert max(made) <= 500_000
    wanted = {w: sum(v != w and sum(a != b for a, b in zip(v, w, strict=True)) == 1 for v in words) for w in words[::300]}
    assert {w: near.get(w, 0) for w in wanted} == wanted
