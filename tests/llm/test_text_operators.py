"""Fingerprints, the n-gram join, packing, personal data and the pipeline against brute force."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from corpuscle.llm import fingerprint, ngram_join, packing, pii, shingles
from corpuscle.llm.common import mix64, texts_of
from corpuscle.llm.components import components

DOCS = "doc_id bigint, text string, range int, token string"  # extra columns with clashing names


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], DOCS)


def words(rng, n, of=400):
    return " ".join(f"{rng.choice(string.ascii_letters)}{rng.randrange(of)}" for _ in range(n))


# fingerprints


def scalar_parse(text):
    """The parse of one text, symbol by symbol."""
    one = lambda v: int(mix64(np.array([v & (2**64 - 1)], np.uint64))[0])
    symbols = [int(fingerprint._CHARS[ord(c)]) if ord(c) < 1 << 16 else one(ord(c) + 1) for c in text]
    levels, level = [], 0
    while symbols:
        runs = []
        for s in symbols:
            if runs and runs[-1][0] == s:
                runs[-1][1] += 1
            else:
                runs.append([s, 1])
        symbols = [s if n == 1 else one((s * 0x9FB21C651E98DF25 & (2**64 - 1)) ^ one(n)) for s, n in runs]
        low = [s & 0xFFFF for s in symbols]
        label = []
        for i, s in enumerate(low):
            differ = 1 if i == 0 else s ^ low[i - 1]
            place = (differ & -differ).bit_length() - 1 if differ else 0
            label.append(2 * place + (s >> place & 1))
        for _ in range(2):
            new = []
            for i, s in enumerate(label):
                left = s ^ 1 if i == 0 else label[i - 1]
                differ = s ^ left
                place = (differ & -differ).bit_length() - 1 if differ else 0
                new.append(2 * place + (s >> place & 1))
            label = new
        begins = [i for i in range(len(symbols)) if i == 0 or (i < len(symbols) - 1 and label[i] > label[i - 1] and label[i] >= label[i + 1])]
        out = []
        for a, b in zip(begins, [*begins[1:], len(symbols)], strict=True):
            name = sum(s * pow(fingerprint._BASE, k, 1 << 64) for k, s in enumerate(symbols[a:b])) & (2**64 - 1)
            out.append(one(name ^ one(b - a)))
        symbols, level = out, level + 1
        levels.append(symbols)
        if len(symbols) == 1:
            return one(symbols[0] + level), levels
    return 0, levels


TRICKY = ["", "a", "aa", "aaaaaaaaaaaa", "abababababab", "x" * 300 + "y", "That it.", "\U0001f600 astral \U0001f601\U0001f601", "é" * 5 + "ß", "the same words again and again " * 20]


def test_parse_matches_scalar_version():
    rng = random.Random(1)
    texts = TRICKY + [words(rng, rng.randint(1, 60)) for _ in range(20)]
    for text, (root, higher, _) in zip(texts, fingerprint.parse_texts(texts), strict=True):
        want, levels = scalar_parse(text)
        assert root == want
        names = [n for level in levels[2:] for n in level]
        assert len(higher) == len(names)
        first = {int(mix64(np.array([n], np.uint64))[0]) for n in set(names)}
        assert first <= set(higher.tolist())


def test_equal_substrings_share_interior_names():
    rng = random.Random(2)
    shared = words(rng, 400)
    a, b = (fingerprint.parse_texts([words(rng, k) + " " + shared + " " + words(rng, k)])[0][1] for k in (3, 90))
    alone = fingerprint.parse_texts([shared])[0][1]
    for other in (a, b):
        assert len(set(alone.tolist()) & set(other.tolist())) > 0.85 * len(alone)


def test_fingerprints_of_documents(spark):
    rng = random.Random(3)
    rows = [(i * 3, words(rng, rng.choice([0, 1, 5, 80, 600]))) for i in range(60)] + [(200, t) for t in TRICKY[:3]] + [(None, None), (500, words(rng, 60_000)), (501, rows_text := words(rng, 90)), (502, rows_text)]
    got = fingerprint.fingerprint_documents(docs_of(spark, rows), ranges=7).collect()
    assert len(got) == len(rows)
    order = sorted(((i is not None, i, t or "") for i, t in rows), key=lambda r: (r[0], r[1] or 0, r[2]))
    want = collections.Counter()
    for k, (_, i, t) in enumerate(order):
        e = fingerprint.edited(t, order[(k + 1) % len(order)][2])
        assert len(e) <= len(t)
        one, new, nxt = fingerprint.fingerprints([t, e, order[(k + 1) % len(order)][2]])
        want[(i, len(t), hashlib.sha256(e.encode()).hexdigest(), one, new, fingerprint.likeness(one, new), fingerprint.likeness(one, nxt))] += 1
    assert collections.Counter(tuple(r) for r in got) == want
    long = [r for r in got if r.n_chars > 2000]
    assert np.mean([r.near_edited for r in long]) > 0.4 and np.mean([r.near_next for r in long]) < 0.1
    same = [r for r in got if r.doc_id in (501, 502)]
    assert same[0].fingerprint == same[1].fingerprint and min(same, key=lambda r: r.doc_id).near_next == 1.0


@pytest.mark.parametrize("rows", [[], [(1, "only one")], [(None, None)]])
def test_fingerprints_of_few_documents(spark, rows):
    got = fingerprint.fingerprint_documents(docs_of(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.near_next == 1.0 for r in got)


# n-gram join


def brute_groups(rows, n, percent):
    sets = []
    for _, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    parts = collections.defaultdict(list)
    for i in range(len(rows)):
        parts[find(i)].append(rows[i][0])
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in parts.items()}
    return collections.Counter((rows[i][0], len(sets[i]), least[find(i)]) for i in range(len(rows)))


def edit(rng, text, k):
    w = text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
    return " ".join(w)


def family_rows(rng):
    rows = []
    for _ in range(6):
        base = words(rng, rng.choice([12, 40, 150]))
        rows += [edit(rng, base, rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.choice([1, 3, 12]))]
    rows += ["", None, " \t\n", "a", "A", "a b", "A  b", "a b c", "É é", "dup " * 50, "dup " * 51, words(rng, 30_000)]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("n", "percent", "seed"), [(3, 90, 1), (5, 80, 2), (3, 60, 3)])
def test_join_components(spark, n, percent, seed):
    rng = random.Random(seed)
    rows = family_rows(rng) + [(3, "repeated id with another text"), (3, "repeated id with another text")]
    got = ngram_join.ngram_jaccard_groups(docs_of(spark, rows).repartition(5), n, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, n, percent)


def test_join_large_family_loses_no_component(spark, monkeypatch):
    """A family whose members link through few of them, with salts from the start and texts joined by a shuffle."""
    monkeypatch.setattr(ngram_join, "SALTED_FROM", 4)
    monkeypatch.setattr(ngram_join, "BROADCAST_IDS", 0)
    rng = random.Random(4)
    base = words(rng, 60)
    rows = list(enumerate([edit(rng, base, 1 + i % 4) for i in range(70)] + [base]))
    got = ngram_join.ngram_jaccard_groups(docs_of(spark, rows), 3, 85).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, 3, 85)


@pytest.mark.parametrize(("n", "percent", "changes"), [(3, 90, 57), (5, 80, 45)])
def test_join_of_long_texts_near_the_threshold(spark, n, percent, changes):
    """Sets on both sides of the sizes at which the finer parities begin and double, linked or just not."""
    rng = random.Random(percent)
    rows = []
    for size in (1030, 2056, 4100):
        base = words(rng, size)
        for k in range(-6, 7, 2):
            text = edit(rng, base, size // changes + k)
            rows.append(text if k % 4 else text.rsplit(" ", 12)[0])
    rows = list(enumerate(rows))
    got = ngram_join.ngram_jaccard_groups(docs_of(spark, rows), n, percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_groups(rows, n, percent)


@pytest.mark.parametrize(("one", "other"), [(1025, 1500), (2048, 2049), (1500, 5000), (900, 1100), (4000, 4000)])
def test_fine_parities_turn_down_no_link(spark, one, other):
    """What they allow follows from the bits that differ in the shorter ones' ranges, and every linked pair is allowed."""
    rng = np.random.default_rng(one)
    pool = rng.integers(1, 2**63, one + other, dtype=np.uint64)
    for shared in (0, min(one, other) // 2, min(one, other) - 40, min(one, other)):
        sets = [np.sort(pool[:one]), np.sort(np.concatenate([pool[:shared], pool[one : one + other - shared]]))]
        fine = [ngram_join._fine_parities(s) for s in sets]
        rows = [(len(s), None if f is None else [int(w) for w in f]) for s, f in zip(sets, fine, strict=True)]
        x, y = (spark.createDataFrame([r], "size bigint, fine array<bigint>").alias(a) for r, a in zip(rows, "xy", strict=True))
        got = x.join(y, F.lit(True)).select(ngram_join._fine_parities_allow(80, "x", "y")).first()[0]
        if 100 * shared >= 80 * (one + other - shared):
            assert got
        lengths = [0 if f is None else len(f) for f in fine]
        if not all(lengths) or max(lengths) > 2 * min(lengths):
            assert got
        else:
            bits = 64 * min(lengths)
            differ = np.count_nonzero((np.bincount((sets[0] % bits).astype(int), minlength=bits) + np.bincount((sets[1] % bits).astype(int), minlength=bits)) & 1)
            assert got == (differ <= one + other - 2 * -(-80 * (one + other) // 180))


def test_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_groups(docs_of(spark, [])).count() == 0
    got = ngram_join.ngram_jaccard_groups(docs_of(spark, [(None, "a b c"), (2, None)])).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(None, None), (2, 2)}


def test_join_finds_near_copies_of_texts_with_many_copies(spark):
    """Salts follow from counts that hold copies, so most salts of such a text's shingles are empty."""
    rng = random.Random(5)
    rows, families = [], 8
    for k in range(families):
        text = words(rng, 120, 10_000)
        near = text.split()
        near[60] = "changed"
        rows += [(1000 * k + i, text) for i in range(ngram_join.SALTED_FROM + 90)] + [(1000 * k + 999, " ".join(near))]
    got = ngram_join.ngram_jaccard_groups(docs_of(spark, rows), n=3, percent=90)
    roots = got.groupBy((F.col("doc_id") / 1000).cast("int").alias("family")).agg(F.min("component_id").alias("least"), F.max("component_id").alias("most"))
    assert [(r.least, r.most) for r in roots.orderBy("family").collect()] == [(1000 * k, 1000 * k) for k in range(families)]


def test_keep_one_and_mask_with_the_names_used_inside(spark):
    rows = [(1, "write to ann@example.org now", 7, "kept", "also"), (2, "write to ann@example.org now", 8, "gone", "too"), (3, None, 9, None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, _gone int, _hash string, _values string")
    kept = ngram_join.keep_one(docs).collect()
    assert sorted(tuple(r) for r in kept if r.doc_id != 3) == [rows[0]] and len(kept) == 2
    for most in (pii.BROADCAST_BYTES, -1):
        got = sorted(map(tuple, pii.mask(docs, most).collect()))
        assert got == [(r[0], r[1] and "write to [EMAIL] now", *r[2:]) for r in rows]


def test_keep_one_of_each_group(spark):
    rng = random.Random(5)
    rows = family_rows(rng)
    groups = brute_groups(rows, 5, 80)
    docs = docs_of(spark, rows)
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in groups})
    twice = docs_of(spark, rows + rows + [(0, "an id that stands for two texts")])
    again = ngram_join.keep_one(twice)
    assert again.columns == docs.columns
    assert sorted((r.doc_id, r.text or "") for r in again.collect()) == sorted([(r.doc_id, r.text or "") for r in kept.collect()] + [(0, "an id that stands for two texts")])


def test_keep_one_of_rows_without_doc_id(spark):
    rng = random.Random(15)
    a, b, c, d = (words(rng, 60) for _ in range(4))
    alone = [(None, a), (None, a), (None, a + " more"), (None, b), (1, c)]
    want = [("None", a), ("None", b), ("1", c)]
    for more, kept in (([], []), ([(2, d), (2, d)], [("2", d)])):
        got = ngram_join.keep_one(docs_of(spark, alone + more)).collect()
        assert sorted((str(r.doc_id), r.text) for r in got) == sorted(want + kept)
    named = docs_of(spark, [(5, "x y"), (None, "5:x y"), (None, b)])  # an id and a text that read like another text
    assert sorted(r.text for r in ngram_join.keep_one(named).collect()) == sorted(["x y", "5:x y", b])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aAbé \t\x0b\x1f\n", max_size=30), max_size=6), st.integers(1, 4))
def test_shingle_sets_match_words(texts, n):
    found = shingles.shingle_sets(*texts_of(pa.array(texts, pa.string())), n)
    for text, one in zip(texts, found, strict=True):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text))
        assert len(one) == (len({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))}) if w else 0)
    sets = {}
    for text, one in zip(texts, found, strict=True):
        w = tuple(re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text)))
        assert sets.setdefault(w, one.tolist()) == one.tolist()


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 140)}


# packing


def test_hilbert_curve_steps_to_neighbours():
    for dims, bits in ((2, 4), (3, 2), (4, 2)):
        cells = np.array(np.meshgrid(*[range(1 << bits)] * dims)).reshape(dims, -1).T
        keys = packing.hilbert_keys(cells, bits)
        assert sorted(keys.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(1) == 1).all()


def test_packing_holds_every_id_once(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows = [(i, words(rng, rng.choice([0, 1, 30, 400]))) for i in range(80)] + [(7, None), (7, "repeated"), (7, "repeated"), (None, "no id"), (90, words(rng, 5000)), (91, "<|endoftext|> it's  \n\n\u00e9\U0001f600\t x123")]
    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(docs_of(spark, rows), ranges=3).toPandas()
    got["n"] = got["ids"].map(len) // 4
    want = collections.Counter((i, tuple(coder.encode(t or "", add_special_tokens=False).ids + [0])) for i, t in rows)
    found = collections.Counter()
    open_ = {}
    for r in got.sort_values(["sequence_id", "offset"]).itertuples():
        ids = np.frombuffer(r.ids, "<u4").tolist()
        key = None if r.doc_id != r.doc_id else int(r.doc_id)
        have = open_.get(key, []) if r.start else []
        assert len(have) == r.start
        have = have + ids
        open_[key] = have
        if len(have) == r.doc_tokens:
            found[(key, tuple(have))] += 1
    assert found == want
    for _, part in got.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *np.cumsum(part["n"])[:-1]]
        total = part["n"].sum()
        assert total <= 1024 and total & (total - 1) == 0
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_cut_is_binary():
    assert all(sum(packing.cut(n)) == n for n in range(1024)) and packing.cut(700) == [512, 128, 32, 16, 8, 4]


def test_similar_documents_lie_together():
    rng = random.Random(8)
    base = words(rng, 300)
    keys = packing.curve_keys(*texts_of(pa.array([base, base, edit(rng, base, 1)])))
    assert keys[0] == keys[1]


# personal data


def brute_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [f"ip:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [f"card:{m.start()}:{m.end()}" for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 13 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    return out + [f"phone:{m.start()}:{m.end()}" for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(digits(m[0])) <= 15]


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="a.@-+0123459 ()%_é", max_size=60))
def test_base_spans_match_patterns(text):
    assert pii.joined(pii.base_spans(text)) == ",".join(brute_spans(text))


def test_base_spans_are_linear_in_long_runs():
    for text in ("1" * 400_000, "a" * 400_000 + "@", "a@" * 100_000, "1." * 200_000, "+1" * 200_000, "+" + "1 " * 200_000):
        pii.base_spans(text)


def pii_rows():
    rng = random.Random(9)
    rows = []
    for i in range(40):
        rows.append((i, f"{words(rng, 5)} please write to agent{i}@mail{i % 5}.example.com or call soon {words(rng, 5)}"))
    for i in range(40, 60):
        rows.append((i, f"{words(rng, 3)} please write to ID{i}77{i}881 or call later on"))
    rows += [(100 + i, f"In version 20{i}1987654 released long ago {words(rng, 9)}") for i in range(5)]
    return rows + [(200, None), (201, ""), (202, "é 1.2.3.4 and 4111 1111 1111 1111, +1 (743) 555-3824"), (202, "é 1.2.3.4 and 4111 1111 1111 1111, +1 (743) 555-3824")]


def test_contexts_discover_identifiers(spark):
    rows = pii_rows()
    got = collections.defaultdict(list)
    for r in pii.find(docs_of(spark, rows)).collect():
        got[r.doc_id].append(r)
    for i, text in rows:
        base = brute_spans(text or "")
        for r in got[i]:
            assert r.base_sha256 == hashlib.sha256(",".join(base).encode()).hexdigest()
            assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s.startswith(k) for s in base) for k in ("email", "ip", "card", "phone"))
            spans = [s for s in r.spans.split(",") if s]
            assert spans[: len(base)] == base
            more = [tuple(map(int, s.split(":")[1:])) for s in spans[len(base) :]]
            assert [text[a:b] for a, b in more] == ([f"ID{i}77{i}881"] if 40 <= i < 60 else [])
    assert len(got[202]) == 2 and sum(map(len, got.values())) == len(rows)


def test_found_identifiers_make_further_contexts_trusted(spark):
    a, b, c = ([f"{k}{i}77{i}881" for i in range(20)] for k in ("ida", "idb", "idc"))
    texts = [f"please write to agent{i}@mail{i}.example.com or call" for i in range(6)] + [f"please write to {v} or call" for v in a]
    texts += [f"his badge number {v} belongs here" for v in a[:4] + b]  # 4 found in the first round, 20 unseen
    texts += [f"her locker code {v} opens this" for v in b[:4] + c]  # 4 found in the second round, 20 unseen
    texts += [f"some release tag {10**6 + i} came along" for i in range(20)]
    number = lambda i: next(n for n in range(10**15 + 10 * i, 10**15 + 10 * i + 10) if not pii.luhn(str(n)))
    texts += [f"invoice total was 10.0.0.{i} units altogether" for i in range(3)] + [f"invoice total was {v} units altogether" for v in (*map(number, range(9)), 7654321)]
    scanned = pii.scan(docs_of(spark, list(enumerate(texts))))
    found = [{r.value for r in pii.bootstrap(scanned, rounds=k).collect()} for k in (1, 2, 3)]
    assert found == [set(a), {*a, *b}, {*a, *b, *c}]


def test_pattern_graph_scores_match_brute_force(spark):
    rng = random.Random(21)
    mentions = []
    for _ in range(400):
        value = rng.randrange(60)
        kinds = [f"< {'abcdef'[rng.randrange(2 + value % 5)]}" for _ in range(rng.randint(1, 3))]
        mentions.append({"start": 0, "end": 1, "seed": value < 15, "refused": 55 <= value, "value": f"v{value}", "patterns": sorted(set(kinds))})
    schema = "mentions array<struct<start:bigint,end:bigint,seed:boolean,refused:boolean,value:string,patterns:array<string>>>"
    scanned = spark.createDataFrame([(mentions[i : i + 4],) for i in range(0, 400, 4)], schema)
    edges = {(p, m["value"]): m for m in mentions for p in m["patterns"]}
    accepted: dict[str, float] = {}
    for _ in range(3):
        known = collections.defaultdict(list)
        for (p, v), m in edges.items():
            score = 1.0 if m["seed"] else 0.0 if m["refused"] else accepted.get(v)
            if score is not None:
                known[p].append(score)
        trusted = {p: sum(k) / (len(k) + 1) for p, k in known.items() if sum(x > 0 for x in k) >= 3 and sum(k) / (len(k) + 1) >= 0.55}
        wrong = collections.defaultdict(lambda: 1.0)
        for (p, v), m in edges.items():
            if not m["seed"] and p in trusted:
                wrong[v] *= 1 - min(trusted[p], 0.999)
        scores = {v: 1 - w for v, w in wrong.items()}
        accepted = {v: x for v, x in scores.items() if x >= 0.7}
    got = {r.value: r.score for r in pii.bootstrap(scanned, 3, 3, 0.55, 0.7).collect()}
    assert got and got == pytest.approx(accepted)


def test_refused_tokens():
    assert [pii.refused(t) for t in ("4111111111111112", "4111-1111-1111-1112", "1.2.3.999", "4111111111111111", "123456789", "id4111111111111112", "1.2.3.4", "1" * 20)] == [True] * 3 + [False] * 5


def test_masking_by_broadcast_and_by_join(spark):
    rows = pii_rows()
    docs = docs_of(spark, rows).withColumn("n_chars", F.length("text").cast("bigint"))
    one, other = pii.mask(docs), pii.mask(docs, most_broadcast=-1)
    assert one.columns == other.columns == docs.columns
    a, b = ([tuple(r) for r in d.orderBy("doc_id", "text").collect()] for d in (one, other))
    assert a == b
    text = {r[0]: r[1] for r in a}
    assert "[EMAIL] or call" in text[1] and "to [ID] or call" in text[45] and text[202] == "é [IP] and [CARD], [PHONE]" and text[200] is None
    assert all(r[1] is None or r[4] == len(r[1]) for r in a)
    assert pii.find(docs_of(spark, [])).count() == 0 and pii.mask(docs_of(spark, [])).count() == 0


# pipeline


def test_pipeline_of_nothing_and_of_very_long_texts(spark, tmp_path):
    rng = random.Random(31)
    long = " ".join(words(rng, 50) for _ in range(1200))
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    for name, rows in (("none", []), ("long", [(1, long, "en", "a", len(long)), (2, long + " end", "en", "a", len(long) + 4), (3, "mail to a@b.cd " + long[::-1], "en", None, 1)])):
        folder = f"{tmp_path}/{name}"
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        got = corpus_pipeline.run(spark, folder).select("doc_id", "doc_tokens", F.length("ids").alias("n")).collect()
        assert {r.doc_id for r in got} <= {1, 3} and bool(got) == bool(rows)
        for i in {r.doc_id for r in got}:
            own = [r for r in got if r.doc_id == i]
            assert sum(r.n for r in own) // 4 % own[0].doc_tokens == 0 and own[0].doc_tokens > 60_000


def test_pipeline_stages_keep_columns_and_effects(spark, tmp_path):
    rng = random.Random(10)
    good = [" ".join("".join(rng.choices("th er on an ing ed the and of".split(), k=2)) for _ in range(rng.randint(20, 120))) for _ in range(120)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(good)]
    rows += [(200 + i, good[i], "en", "s1", len(good[i])) for i in range(20)]  # copies
    rows += [(300 + i, (t := good[i].upper().replace(" ", "!! ")), "en", "s2", len(t)) for i in range(60)]  # junk
    rows += [(400, (t := good[3] + " mail me at some.one@example.com now"), "en", "s0", len(t)), (401, None, None, None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(r[0], int(r[0] < 300), 0) for r in rows if r[0] < 360], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert k == len(corpus_pipeline.STAGES) - 1 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        docs = kept[name] = spark.read.parquet(f"{tmp_path}/{k}")
    ids = {n: [r.doc_id for r in d.select("doc_id").collect()] for n, d in kept.items()}
    assert not [i for i in ids["quality_classifier"] if 300 <= i < 360] and sum(i < 120 for i in ids["quality_classifier"]) > 115
    assert not [i for i in ids["ngram_jaccard_join"] if 200 <= i < 220] and set(ids["ngram_jaccard_join"]) <= set(ids["quality_classifier"])
    assert sorted(ids["pii"]) == sorted(ids["ngram_jaccard_join"])
    assert kept["pii"].where("text like '%@example%'").count() == 0
    assert set(ids["mixing"]) <= set(ids["pii"]) and max(collections.Counter(ids["mixing"]).values()) == 2
    assert set(ids["packing"]) == set(ids["mixing"])
    assert corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "ids").exceptAll(kept["packing"].select("doc_id", "start", "ids")).count() == 0
