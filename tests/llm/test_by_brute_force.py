"""Each operator against a plain form of its definition, on odd cases and on the smallest tables."""

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.conftest import DATA
from tracklane.llm import jaccard_join, language_model, merkle, mixing, packing, quality_rules, secret_scan, sharding, toxicity
from tracklane.llm.common import documents
from tracklane.llm.components import components

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = f"{DATA}/sf0.001"


@pytest.fixture(scope="module")
def small(spark):
    return documents(spark, SMALL)


@pytest.fixture(scope="module")
def small_rows(small):
    return [(r["doc_id"], r["text"], r["source"]) for r in small.collect()]


def both(docs, rows, small, small_rows):
    return ((docs, rows), (small, small_rows))


def plain_likeness(a, b):
    """Over flat bags of clauses."""
    x, y = (Counter(merkle._clauses(t.encode())) for t in (a, b))
    total = len(a.encode()) + len(b.encode())
    return 2 * sum(min(n, y[c]) * len(c) for c, n in x.items()) / total if total else 1.0


def test_fingerprints_of_edited_texts(docs, rows, small, small_rows):
    for df, plain in both(docs, rows, small, small_rows):
        order = sorted(plain, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want = []
        for k, (i, t, _) in enumerate(order):
            t, n = t or "", order[(k + 1) % len(order)][1] or ""
            q = len(t) // 4
            edited = t[: len(t) - q] + n[:q] if q else t
            want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), t == edited, *(round(plain_likeness(t, x), 9) for x in (edited, n))))
        got = merkle.compare_with_edited(df).collect()
        key = lambda x: (x[0] is not None, x[0] or 0, *x[1:])
        assert sorted(((r[0], r[1], r[2], r[3] == r[4], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got), key=key) == sorted(want, key=key)
        assert all((r["edit_at"] is None) == (r[3] == r[4]) for r in got)


def test_equal_roots_mean_equal_texts_and_branches_locate_edits():
    texts = ["", "a", "a\n", "a\n\nb", "a\n\n\nb", "a. b", "a.b", "x" * 999, "x" * 1000, "ü" * 400, "one two.\nthree"]
    roots = {merkle.tree(t.encode()).hash for t in texts}
    assert len(roots) == len(texts)
    moved = merkle.edits(*(merkle.tree(t.encode()) for t in ("one.\ntwo.\nthree.\nfour.\n\nfive.", "one.\nthree.\ntwo.\nfour.\n\nfive.")))
    assert moved in ([(0, 1)], [(0, 2)])  # a moved paragraph is an edit
    assert merkle.edits(*(merkle.tree(t.encode()) for t in ("a.\na.\nb.", "a.\nb."))) in ([(0, 0)], [(0, 1)])
    assert merkle.first_difference(*(merkle.tree(t.encode()) for t in ("a.\nb.\n\nc.\nd.", "a.\nb.\n\nc.\ne."))) == 3
    assert merkle.first_difference(*(merkle.tree(t.encode()) for t in ("a.\nb.\n\nc.", "a.\nb.\n\n"))) == 2
    a, b = "first line.\nsecond line.\n\nthird part.\nfourth.", "first line.\nsecond one.\n\nthird part.\nfourth."
    assert merkle.edits(merkle.tree(a.encode()), merkle.tree(b.encode())) == [(0, 1)]
    assert 0.5 < merkle.likeness(merkle.tree(a.encode()), merkle.tree(b.encode())) < 1


def test_ids_are_whole_numbers_of_any_width(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (None, None)], "doc_id int, text string")
    out = merkle.compare_with_edited(df)
    assert out.schema["doc_id"].dataType.simpleString() == "int" and {r["doc_id"] for r in out.collect()} == {1, 2, None}
    with pytest.raises(TypeError):
        merkle.compare_with_edited(df.withColumn("doc_id", df["doc_id"].cast("string")))


def test_packing_is_a_round_trip(spark, docs, rows, small, small_rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (df, plain), length in zip(both(docs, rows, small, small_rows), (64, 1024), strict=True):
        pieces = packing.pack(df, length=length).collect()
        streams = defaultdict(list)
        for r in pieces:
            streams[r["sequence_id"]].append((r["offset"], np.frombuffer(r["ids"], "<u4")))
            assert len(r["ids"]) == 4 * r["length"]
        full = []
        for s in range(len(streams)):
            at = 0
            for offset, ids in sorted(streams[s], key=lambda x: x[0]):
                assert offset == at
                at += len(ids)
                full.append(ids)
            assert at == length or s == len(streams) - 1
        whole = np.concatenate(full).tolist()
        want = Counter(tuple([*public.encode(t or "", add_special_tokens=False).ids, 0]) for _, t, _ in plain)
        ends, got, last = [i for i, x in enumerate(whole) if x == 0], Counter(), 0
        if not any(0 in x[:-1] for x in want):
            for e in ends:
                got[tuple(whole[last : e + 1])] += 1
                last = e + 1
            assert got == want
        by_doc = defaultdict(list)
        for r in pieces:
            by_doc[r["doc_id"]].append(r)
        for i, t, _ in plain:
            if i is not None and sum(x[0] == i for x in plain) == 1:
                ids = np.array([*public.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
                assert b"".join(bytes(r["ids"]) for r in sorted(by_doc[i], key=lambda r: r["start"])) == ids.tobytes()
                assert {r["doc_tokens"] for r in by_doc[i]} == {len(ids)}


def test_ids_of_larger_vocabularies_keep_their_width(spark, tmp_path):
    import base64

    with open(packing.vocabulary(), "rb") as f:
        ranks = [line.split() for line in f]
    file = tmp_path / "shifted.tiktoken"
    file.write_bytes(b"".join(b"%s %d\n" % (a, int(b) + 70_000) for a, b in ranks))
    assert base64.b64decode(ranks[0][0])
    df = spark.createDataFrame([(1, "some words, and more words"), (2, None)], "doc_id long, text string")
    narrow, wide = ([np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(df, ranks=x).orderBy("doc_id").collect()] for x in (None, str(file)))
    assert wide == [[i + 70_000 if i else 0 for i in x] for x in narrow] and wide[1] == [0]


def test_long_texts_are_cut_where_ids_dont_depend_on_it(monkeypatch):
    text = "Über  the\n\n lazy 'dogs 123 <|endoftext|> x" * 40
    whole = packing.Encoder().ids(text).tolist()
    monkeypatch.setattr(packing, "CHUNK", 50)
    assert packing.Encoder().ids(text).tolist() == whole


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    letters = lambda w: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w)
    names = "|".join(letters(w) for w in ("password", "passwd", "secret", "token")) + "|" + letters("api") + "_?" + letters("key")
    kinds = ((f"({names})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12), ("AKIA[A-Z0-9]+", 0, 18), ("[0-9a-f]+", 0, 16))
    return sorted((m.start(), o, k, m.end()) for o, (k, (p, g, n)) in enumerate(zip(("assign", "access", "hex"), kinds, strict=True)) for m in re.finditer(p, text) if len(m[g]) >= n)


def test_secret_scan_equals_a_full_scan(docs, rows, small, small_rows):
    for df, plain in both(docs, rows, small, small_rows):
        got = Counter((r["doc_id"], tuple((s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] in ("assign", "access", "hex"))) for r in secret_scan.find_secrets(df).collect())
        assert got == Counter((i, tuple((k, a, b) for a, _, k, b in base_spans(t or ""))) for i, t, _ in plain)
    assert any(base_spans(t or "") for _, t, _ in rows)


def test_trigram_queries_are_mandatory():
    q = secret_scan.trigram_query(secret_scan.BASE[0].pattern)
    assert frozenset({b"tok", b"oke", b"ken"}) in q and len(q) == 6
    assert secret_scan.trigram_query(secret_scan.BASE[2].pattern) is None
    assert secret_scan.trigram_query(rb"ab+c") is None
    assert secret_scan.trigram_query(rb"(abcd|xyz)?q") is None


def test_redaction_masks_every_span(docs, rows):
    out = secret_scan.redact(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    found = {r["doc_id"]: r for r in out.collect()}
    assert "[secret]" in found[11]["text"] and "00112233" not in found[11]["text"] and found[11]["n_chars"] == len(found[11]["text"])
    assert found[1]["text"] is None and found[0]["n_chars"] == -1


def test_redaction_leaves_nothing_of_a_private_key(spark):
    luck = np.random.default_rng(3)
    line = lambda n: "".join(luck.choice([*"abcXYZ019+/"], n))
    lines = [line(64), line(64), line(9)]
    begin, end = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
    kept = [("bé ", " after it"), ("", "\nA word, and more."), ("x ", "")]
    bodies = ["\n{}\n", "\r\n{}\r\n", "\nProc-Type: 4,ENCRYPTED\nDEK-Info: AES-128-CBC,0AB1\n\n{}\n", "\\n{}\\n"]
    texts, want = [], []
    for before, after in kept:
        for form in bodies:
            body = form.format(("\\n" if form[0] == "\\" else "\n").join(lines))
            texts += [before + begin + body + end + after, before + begin + body.rstrip("\r\n") + "\n\nAn open key. " + begin + "\n" + lines[0] + "\n" + lines[2]]
            want += [before + "[secret]" + after, None]
    texts += [begin + " alone is a header", "no key"]
    want += ["[secret] alone is a header", "no key"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r["text"] for r in secret_scan.redact(df).orderBy("doc_id").collect()]
    for t, g, w in zip(texts, got, want, strict=True):
        assert not any(x in g for x in lines), (t, g)
        assert g == w if w is not None else "An open key. [secret]" in g
    spans = {r["doc_id"]: r["spans"] for r in secret_scan.find_secrets(df).collect()}
    assert [(s["start"], s["end"]) for s in spans[0] if s["kind"] == "private_key"] == [(3, len(texts[0]) - len(" after it"))]


def test_quality_figures(docs, rows, small, small_rows):
    for df, plain in both(docs, rows, small, small_rows):
        want = Counter()
        for i, t, _ in plain:
            t = t or ""
            w = WORD.findall(t)
            windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
            covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
            lines = [x for x in t.split("\n") if WORD.search(x)]
            want[i, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)] += 1
        got = quality_rules.base_measures(df).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()
        assert Counter(tuple(r) for r in got) == want


def test_cascade_order_never_changes_the_verdict(docs):
    split, rules = quality_rules.split_once(docs)
    names = [r.name for r in rules]
    verdicts = lambda df: {(r["doc_id"], r["text"], r["rejected_by"] is None) for r in df.collect()}
    one = verdicts(quality_rules.cascade(split, rules, names))
    two = verdicts(quality_rules.cascade(split, rules, names[::-1]))
    assert one == two == verdicts(quality_rules.judge(docs)) and len({x[2] for x in one}) == 2


def test_later_rules_are_not_evaluated(docs):
    from pyspark.sql import functions as F

    split, _ = quality_rules.split_once(docs)
    rules = [quality_rules.Rule("all", F.size("_words") >= 0), quality_rules.Rule("never", F.raise_error(F.concat(F.lit("evaluated for "), "_text")).cast("boolean"))]
    assert {r["rejected_by"] for r in quality_rules.cascade(split, rules, ["all", "never"]).collect()} == {"all"}


def test_rules_are_ordered_by_what_they_still_reject():
    patterns = {(): 50, ("a", "b"): 30, ("b",): 5, ("c",): 15}
    assert quality_rules.by_rejection_per_cost({"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0}, patterns) == ["b", "c", "a", "d"]
    assert quality_rules.by_rejection_per_cost({"a": 1.0, "b": 8.1, "c": 7.9}, patterns) == ["a", "c", "b"]
    assert quality_rules.by_rejection_per_cost({"b": 1.0, "a": 2.0}, {}) == ["a", "b"]


def test_shards_are_even_gapless_and_keep_groups(docs, rows, small, small_rows):
    for df, plain in both(docs, rows, small, small_rows):
        out = sharding.shard(df).collect()
        assert Counter((r["doc_id"], r["size"], r["key"]) for r in out) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in plain)
        sizes, slots, shards = Counter(), defaultdict(list), defaultdict(set)
        for r in out:
            sizes[r["shard"]] += r["size"]
            slots[r["shard"]].append(r["slot"])
            shards[r["key"]].add(r["shard"])
        assert all(sorted(s) == list(range(len(s))) for s in slots.values())
        largest = max(r["size"] for r in out)
        assert all(abs(sizes[s] - sum(sizes.values()) / 8) <= largest + 1 for s in range(8))
        assert all(len(x) == 1 for x in shards.values())


def test_copies_stay_together_while_a_shard_has_room(spark):
    """Through the query's operator: groups of 2 % to 11 % of the bytes are whole, one of a third is split, shards are even."""
    copies = {f"copied text {k} ": n for k, n in ((1, 80), (2, 200), (3, 450), (4, 90), (5, 1600))}
    texts = [t * 5 for t, n in copies.items() for _ in range(n)] + [f"text {i} of its own, some words more" for i in range(3000)] + [None, "", ""]
    out = sharding.shard(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    sizes, shards, slots = Counter(), defaultdict(set), defaultdict(list)
    for r in out:
        sizes[r["shard"]] += r["size"]
        shards[r["key"]].add(r["shard"])
        slots[r["shard"]].append(r["slot"])
    large = zlib.crc32(("copied text 5 " * 5).encode())
    assert len(out) == len(texts) and all(len(x) == 1 for k, x in shards.items() if k != large) and len(shards[large]) > 1
    mean = sum(sizes.values()) / 8
    assert all(abs(sizes[s] - mean) < 0.03 * mean for s in range(8))
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())


def test_heavy_keys_find_room():
    place, room = sharding.pinned([(1, 50), (2, 50), (3, 30), (4, 90)], 400, 4)
    assert place == {4: 0, 1: 1, 2: 2, 3: 3} and room == [10, 50, 50, 70]
    place, room = sharding.pinned([(1, 300), (2, 20)], 400, 4)
    assert place == {2: 0} and room == [80, 100, 100, 100]
    assert sharding.pinned([], 0, 2) == ({}, [0, 0])


def test_a_key_larger_than_a_shard_is_subdivided(spark):
    df = spark.range(4000).selectExpr("id AS doc_id", "if(id % 2 = 0, 'the same text again and again', concat('text number ', id)) AS text")
    out = sharding.shard(df).groupBy("shard").sum("size").collect()
    total = sum(r[1] for r in out)
    assert len(out) == 8 and all(abs(r[1] - total / 8) < 0.02 * total for r in out)


def test_mix_comes_near_its_targets(docs, rows, small, small_rows):
    from pyspark.sql import functions as F

    for df, plain in both(docs, rows, small, small_rows):
        out = mixing.mix(df.select("doc_id", "text", "source", F.lit(9).alias("passes")), mixing.words("text"), F.array("source")).collect()
        sizes, taken, largest = Counter(), Counter(), Counter()
        for r in out:
            n = len(WORD.findall(r["text"] or ""))
            sizes[r["source"]] += n
            taken[r["source"]] += n * r["times"]
            largest[r["source"]] = max(largest[r["source"]], n)
            assert 0 <= r["times"] <= 2 and r["passes"] == 9
        want = mixing.targets(dict(sizes))
        assert len(out) == len(plain) and all(abs(taken[s] - want[s]) <= largest[s] for s in sizes)
        assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-6 * sum(sizes.values())


def test_flow_routes_overlapping_sources_at_least_cost():
    capacity = {("a",): 10, ("a", "b"): 20, ("b", None): 10, (None,): 5}
    flow = mixing.route(capacity, {"a": 25.0, "b": 20.0, None: 10.0})
    assert {s: sum(x.get(s, 0) for x in flow.values()) for s in ("a", "b", None)} == {"a": 25, "b": 20, None: 10}
    used = {p: sum(x.values()) for p, x in flow.items()}
    assert all(used[p] >= capacity[p] for p in capacity) and sum(used.values()) == 55  # each once before any again
    assert mixing.targets({"a": 10, "b": 100, None: 100}) == pytest.approx({"a": 20.0, "b": 98.3333, None: 196.6667}, abs=1e-3)
    assert mixing.targets({}) == {} and mixing.targets({"a": 0}) == {"a": 0.0}


def test_routing_thousands_of_patterns():
    luck = np.random.default_rng(6)
    names = [f"s{i}" for i in range(1000)]
    capacity = {tuple(sorted(luck.choice(names, int(luck.integers(1, 4)), False))): int(luck.integers(1, 10**6)) for _ in range(10_000)}
    sizes = Counter()
    for p, n in capacity.items():
        for s in p:
            sizes[s] += n
    began = time.process_time()
    flow = mixing.route(capacity, mixing.targets(dict(sizes), share=0.7))
    assert time.process_time() - began < 10
    into = Counter()
    for p, x in flow.items():
        assert 0 <= sum(x.values()) <= 2 * capacity[p]
        into.update(x)
    assert all(into[s] <= t + 1 for s, t in mixing.targets(dict(sizes), share=0.7).items())


def test_flow_is_of_least_cost():
    """Against all ways to send whole tokens through small networks: first as much as possible, then as cheap."""
    luck = np.random.default_rng(8)
    for _ in range(30):
        capacity = {("a",): int(luck.integers(0, 3)), ("a", "b"): int(luck.integers(1, 3)), ("b",): int(luck.integers(0, 3))}
        target = {"a": float(luck.integers(0, 6)), "b": float(luck.integers(0, 6))}
        best = min(
            (-(x + y + u + w), sum(max(0, n - c) for n, c in zip((x, y + u, w), capacity.values(), strict=True)))
            for x in range(2 * capacity[("a",)] + 1) for y in range(2 * capacity[("a", "b")] + 1) for u in range(2 * capacity[("a", "b")] + 1 - y) for w in range(2 * capacity[("b",)] + 1)
            if x + y <= target["a"] and u + w <= target["b"]
        )
        flow = {p: sum(f.values()) for p, f in mixing.route(capacity, target).items()}
        assert (-sum(flow.values()), sum(max(0, flow[p] - n) for p, n in capacity.items())) == best


def test_long_runs_are_scanned_once():
    scanner = secret_scan.Scanner(secret_scan.MORE)
    texts = [b"a" * 1_000_000 + b"://", b"eyJ" * 300_000 + b".eyJ", b"-----BEGIN PRIVATE KEY-----" * 20_000, b"x://u:" + b"p" * 1_000_000, b"https://me:secret1@host"]
    began = time.process_time()
    found = scanner.block(texts)
    assert time.process_time() - began < 10
    assert [k for k, _, _ in found[4]] == ["url_password"] and not found[0] and not found[3]


def plain_components(plain, n, p, q):
    sets = []
    for i, t, _ in plain:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])))
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and q * len(a & b) >= p * len(a | b):
                parent[root(x)] = root(y)
    least = {}
    for x, (i, s) in enumerate(sets):
        if i is not None and s:
            least[root(x)] = min(least.get(root(x), i), i)
    return Counter((i, len(s), least.get(root(x)) if s else i) for x, (i, s) in enumerate(sets))


@pytest.mark.parametrize(("n", "p"), [(3, 90), (5, 80), (2, 50)])
def test_similarity_join_loses_no_link(docs, rows, small, small_rows, n, p, monkeypatch):
    monkeypatch.setattr(jaccard_join, "SMALL", 3)
    monkeypatch.setattr(jaccard_join, "CROWD", 4)
    monkeypatch.setattr(jaccard_join, "COMMON", 3)
    for df, plain in both(docs, rows, small, small_rows)[: 1 if p == 50 else 2]:
        got = Counter(tuple(r) for r in jaccard_join.near_duplicates(df, words=n, p=p, q=100).select("doc_id", "n_shingles", "component_id").collect())
        assert got == plain_components(plain, n, p, 100)


def test_members_of_a_large_group_are_compared_with_one_hub(spark, monkeypatch):
    luck = random.Random(8)
    base, rows = [f"w{luck.randrange(4000)}" for _ in range(200)], []
    for i in range(120):
        words = list(base)
        for _ in range(luck.randint(1, 9)):
            words[luck.randrange(len(words))] = f"w{luck.randrange(4000)}"
        rows.append((i, " ".join(words)))
    rows.append((120, " ".join(base)))
    stars, compared = [], jaccard_join._compared
    monkeypatch.setattr(jaccard_join, "_compared", lambda s, *more: stars.append(s.count()) or compared(s, *more))
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain_components([(*r, None) for r in rows], 5, 80, 100)
    assert stars[0] < 2 * len(rows)


def test_members_that_lack_the_same_features_of_a_hub_are_not_crowded(spark, monkeypatch):
    luck = random.Random(9)
    base, rows = [f"w{luck.randrange(4000)}" for _ in range(200)], []
    for i in range(300):
        words = list(base)
        for _ in range(luck.randint(3, 9)):
            words[luck.randrange(len(words))] = f"w{luck.randrange(4000)}"
        rows.append((i, " ".join(words)))
    rows.append((300, " ".join(base)))
    spread, made, entries = [], [], jaccard_join._entries

    def counted(done):
        spread.append(done.filter("large").selectExpr("sum(size(delta))", "sum(d)").first())
        out = entries(done)
        made.append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "_entries", counted)
    got = Counter(tuple(r) for r in jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id").collect())
    assert got == plain_components([(*r, None) for r in rows], 5, 80, 100)
    assert len(made) == 1 and made[0] < len(rows)
    assert spread[0][0] < 0.75 * spread[0][1]


def test_similar_sets_share_a_signature():
    luck = np.random.default_rng(1)
    for p in (50, 80, 90):
        enum = jaccard_join.PartEnum(p, 100)
        for _ in range(400):
            size = int(luck.choice([3, 8, 12, 20, 45, 100, 300]))
            a = np.unique(luck.integers(0, 1 << 63, size, np.uint64))
            total = 2 * len(a)
            d = enum.most(total)
            gone = int(luck.integers(0, d + 1))
            b = np.unique(np.concatenate([a[gone // 2 :], luck.integers(0, 1 << 63, gone - gone // 2, np.uint64)]))
            common = len(np.intersect1d(a, b))
            if enum.similar(len(a), len(b), common) and len(b) and not np.array_equal(a, b):
                (x, need_x), (y, need_y) = enum.signatures(a, len(a)), enum.signatures(b, len(b))
                both = np.intersect1d(x, y)
                assert len(both), (p, size, gone)
                for own, need in ((x, need_x), (y, need_y)):
                    counts = Counter(need[np.isin(own, both)].tolist())
                    assert any(n >= k % (1 << 16) for k, n in counts.items()), (p, size, gone)


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(300, 340)] + [(7, 7), (400, 399), (399, 400)]
    out = {r["node"]: r["component"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert out == {**{i: 100 for i in range(100, 161)}, 5: 5, **{k: 5 for k in range(300, 340)}, 399: 399, 400: 399}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_unigram_base_and_probabilities(docs, rows, spark):
    from pyspark.sql import functions as F

    got = language_model.score(docs, F.coalesce(F.col("doc_id") % 4 != 1, F.lit(True))).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b""]
    counts = Counter(w for i, t, _ in rows if i is None or i % 4 != 1 for w in tokens(t))
    total, unit = sum(counts.values()), math.log10(sum(counts.values()) + len(counts) + 1)
    want = sorted((i or -1, len(tokens(t)), sum(counts[w] > 0 for w in tokens(t)), round(sum(math.log10(counts[w] + 1) - unit for w in tokens(t)), 6)) for i, t, _ in rows)
    assert sorted((r["doc_id"] or -1, r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert {r["train_tokens"] for r in got} == {total} and all(r["score"] < 0 for r in got)
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_every_training_document_is_trained(spark, monkeypatch):
    df = spark.range(300).selectExpr("id AS doc_id", "repeat(concat('some words of ', id, ' '), 20) AS text").repartition(3)
    v = language_model.vocabulary(language_model.word_counts(df, "text"))
    net = language_model.start_network(v)

    def seen(v, streams, begin, **more):  # a network that holds how often it has seen each symbol
        out = begin.copy()
        out.word_bias += np.bincount(np.concatenate(streams), minlength=v.head)[: v.head]
        return out

    monkeypatch.setattr(language_model, "train", seen)
    empty = language_model.Network(*(np.zeros_like(p) for p in net.parts()))
    got = language_model.refined(df, v, empty, "text").word_bias
    assert got * 3 == pytest.approx(v.counts[: v.head], rel=0.1)  # the mean of three copies


def test_copies_are_drawn_in_proportion(spark):
    df = spark.range(30000).selectExpr("if(id % 5 = 0, null, id) AS doc_id", "if(id % 3 = 0, 'the same text', concat('text ', id)) AS text")
    drawn = [bytes(r["t"]) for r in language_model.start_sample(df, 0.05, "doc_id", "text").collect()]
    assert len(drawn) == pytest.approx(1500, rel=0.15) and drawn.count(b"the same text") == pytest.approx(500, rel=0.25)


def test_small_partitions_train_too(spark):
    df = spark.createDataFrame([(i, f"few words {i}") for i in range(12)], "doc_id long, text string").repartition(6)
    v = language_model.vocabulary(language_model.word_counts(df, "text"))
    net = language_model.start_network(v)
    assert not np.allclose(language_model.refined(df, v, net, "text").words, net.words)
    unlike = lambda *streams: language_model.train(v, list(map(np.array, streams)), passes=1, lanes=1)
    assert not np.allclose(unlike([1] * 16 + [2]).words, unlike([1] * 16 + [3]).words)  # the last token counts too


def test_language_model_sums_to_one():
    words = [b"", *(f"w{i}".encode() for i in range(300))]
    counts = np.arange(301, 0, -1)
    tails = np.ones(language_model.TAILS)
    v = language_model.Vocabulary(words, counts, int(counts.sum()), 301, tails)
    net = language_model.train(v, [np.array([5, 6, 7, 0] * 8)] * 20, passes=1)
    h = np.random.default_rng(0).normal(0, 1, (1, language_model.STATE)).astype(np.float32)
    every = np.arange(v.head + language_model.TAILS)
    logs = language_model.log_probs(net, v, np.repeat(h.T, len(every), 1), every)
    assert np.exp(logs.astype(float)).sum() == pytest.approx(1, abs=1e-4)


def plain_log_probability(net, v, stream):
    """A token at a time, every sum written out, in double precision."""
    inputs, state, classes, class_bias, words, word_bias = (p.astype(float) for p in net.parts())
    n, total, last, h = language_model.STATE, 0.0, v.head + language_model.TAILS, np.zeros(language_model.STATE)
    for y in stream:
        a, s = inputs[last], h @ state
        z, r = (1 / (1 + np.exp(-(a[k * n : k * n + n] + s[k * n : k * n + n]))) for k in (0, 1))
        h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * s[2 * n :])
        c = y // language_model.CLASS if y < v.head else y - v.head + v.classes
        p = np.exp(h @ classes + class_bias)
        total += np.log10(p[c] / p.sum())
        if y < v.head:
            block = slice(c * language_model.CLASS, min((c + 1) * language_model.CLASS, v.head))
            p = np.exp(words[block] @ h + word_bias[block])
            total += np.log10(p[y - block.start] / p.sum())
        last = y
    return total


def test_scores_are_those_of_a_plain_network():
    luck = np.random.default_rng(3)
    words = [b"", *(f"w{i}".encode() for i in range(150))]
    v = language_model.Vocabulary(words, np.arange(151, 0, -1), 11476, 151, np.ones(language_model.TAILS))
    streams = [luck.integers(0, v.head + language_model.TAILS, n) for n in (1, 2, 70, 200, 5)]
    net = language_model.train(v, streams, passes=2, lanes=3)
    assert language_model.document_scores(net, v, streams) == pytest.approx([plain_log_probability(net, v, s) for s in streams], rel=1e-4)


def test_gradients_are_those_of_the_loss():
    luck = np.random.default_rng(4)
    words = [b"", *(f"w{i}".encode() for i in range(70))]
    v = language_model.Vocabulary(words, np.arange(71, 0, -1), 2556, 71, np.ones(language_model.TAILS))
    net = language_model.start_network(v)
    start = v.head + language_model.TAILS
    x, y = luck.integers(0, v.head, (4, 3)), luck.integers(0, v.head + language_model.TAILS, (4, 3))
    x[0], x[2, 1] = start, start
    h = np.zeros((language_model.STATE, 3), np.float32)
    _, grads = language_model._window(net, v, x, y, h)

    def loss(net):  # each lane by itself, cut where a document starts
        out = 0.0
        for k in range(3):
            cuts = [*np.flatnonzero(x[:, k] == start), 4]
            out -= sum(plain_log_probability_after(net, v, x[a:b, k], y[a:b, k]) for a, b in zip(cuts, cuts[1:], strict=False))
        return out / y.size

    for p, g in zip(net.parts(), grads, strict=True):
        for _ in range(12):
            at = tuple(int(luck.integers(0, n)) for n in p.shape) if p is not net.inputs else (int(luck.choice(x.ravel())), int(luck.integers(0, p.shape[1])))
            kept, wide = p[at], np.float32(2e-2)
            p[at] = kept + wide
            up = loss(net)
            p[at] = kept - wide
            down = loss(net)
            p[at] = kept
            assert g[at] == pytest.approx((up - down) / (2 * float(wide)), abs=3e-4)


def plain_log_probability_after(net, v, x, y):
    """Natural log of the outputs ``y`` after the inputs ``x``, the first of which starts a document."""
    assert x[0] == v.head + language_model.TAILS
    total, n = 0.0, language_model.STATE
    inputs, state, classes, class_bias, words, word_bias = (p.astype(float) for p in net.parts())
    h = np.zeros(n)
    for i, o in zip(x, y, strict=True):
        a, s = inputs[i], h @ state
        z, r = (1 / (1 + np.exp(-(a[k * n : k * n + n] + s[k * n : k * n + n]))) for k in (0, 1))
        h = z * h + (1 - z) * np.tanh(a[2 * n :] + r * s[2 * n :])
        c = o // language_model.CLASS if o < v.head else o - v.head + v.classes
        p = np.exp(h @ classes + class_bias)
        total += np.log(p[c] / p.sum())
        if o < v.head:
            block = slice(c * language_model.CLASS, min((c + 1) * language_model.CLASS, v.head))
            p = np.exp(words[block] @ h + word_bias[block])
            total += np.log(p[o - block.start] / p.sum())
    return total


def test_state_is_carried_across_windows(monkeypatch):
    words = [b"", *(f"w{i}".encode() for i in range(50))]
    v = language_model.Vocabulary(words, np.arange(51, 0, -1), 1326, 51, np.ones(language_model.TAILS))
    net = language_model.start_network(v)
    streams = [np.arange(1, 40), np.arange(3, 9), np.array([0]), np.arange(1, 51)]
    once = language_model.document_scores(net, v, streams)
    monkeypatch.setattr(language_model, "STRETCH", 7)
    monkeypatch.setattr(language_model, "SIDE", 2)
    assert language_model.document_scores(net, v, streams) == pytest.approx(once, rel=1e-5)


def test_nearest_examples_are_exact():
    luck = np.random.default_rng(2)
    x = toxicity.vectors([sorted(luck.choice(40, 6, False)) for _ in range(700)], [[1] * 6] * 700, np.ones(40))
    index = toxicity.Index.of(x, np.arange(700), luck.integers(0, 2, 700).astype(float))
    own = np.concatenate([p.T for p in index.postings])
    q = toxicity.vectors([sorted(luck.choice(40, 5, False)) for _ in range(90)], [[1] * 5] * 90, np.ones(40))
    sims, where = index.nearest(q, 16)
    keys = np.rint(q @ own.T * 2**30)
    for i in range(90):
        assert where[i].tolist() == sorted(range(700), key=lambda j: (-keys[i, j], j))[:16]
    sims, where = index.nearest(q[:3], 800)
    assert (where[:, -1] == -1).all() and (where[:, 699] >= 0).all()


def test_empty_tables(none):
    from pyspark.sql import functions as F

    assert merkle.compare_with_edited(none).count() == merkle.fingerprints(none).count() == 0
    assert packing.pack(none).count() == secret_scan.find_secrets(none).count() == secret_scan.redact(none).count() == 0
    assert sharding.shard(none).count() == quality_rules.judge(none).count() == 0
    assert mixing.mix(none, mixing.words("text"), F.array("source")).count() == 0
    assert jaccard_join.near_duplicates(none).count() == language_model.score(none, F.lit(True)).count() == 0
    assert toxicity.toxicity(none, []).count() == 0


def test_toxicity_is_a_cosine_over_whole_texts(spark):
    luck = np.random.default_rng(5)
    made = lambda: " ".join("".join(chr(97 + c) for c in luck.integers(0, 26, 6)) for _ in range(12))
    base = [made() for _ in range(40)]
    sample = [(i, f"{base[i // 2]} w{i} the of", int(i // 2 % 3 == 0)) for i in range(80)]
    texts = [*(t for _, t, _ in sample), made(), sample[42][1] + " unseen words", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = [Counter((t or "").split()) for t in texts]
    docs_with = Counter(w for c in counts for w in c)
    vector = lambda c: {w: (1 + math.log(k)) * math.log(1 + len(texts) / docs_with[w]) for w, k in c.items()}
    length = lambda v: math.sqrt(sum(x * x for x in v.values()))
    for known in (1 << 17, 0):
        toxicity_known, toxicity.KNOWN = toxicity.KNOWN, known
        try:
            got = {r["doc_id"]: r for r in toxicity.toxicity(df, sample).collect()}
        finally:
            toxicity.KNOWN = toxicity_known
        assert len(got) == len(texts)
        for i, c in enumerate(counts):
            v = vector(c)
            cosines = [sum(x * v.get(w, 0) for w, x in vector(counts[j]).items()) / length(vector(counts[j])) / length(v) if c else 0 for j in range(80)]
            assert [e["similarity"] for e in got[i]["evidence"]] == pytest.approx(sorted(cosines)[-1:-4:-1] if c else [], abs=1e-5)
        assert got[42]["evidence"][0]["id"] == got[81]["evidence"][0]["id"] == 42  # its words are all rare
        assert min(got[42]["score"], got[81]["score"]) > max(0.5, 2 * got[80]["score"])
