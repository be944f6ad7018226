"""The pipeline against a plain version of each stage in turn."""

import hashlib
import re
from collections import Counter

import corpus_pipeline
from tests.conftest import DATA
from tracklane.llm import mixing, secret_scan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = f"{DATA}/sf0.001"


def passes_rules(text: str) -> bool:
    w = WORD.findall(text)
    windows = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    covered = {k + j for k in range(len(w) - 7) if windows[tuple(w[k : k + 8])] > 1 for j in range(8)}
    n, chars = len(w), sum(map(len, w))
    return n >= 20 and 100 * len(covered) <= 30 * n and 10 * sum(c in "#*$%&|<>" for c in text) <= n and 10 * text.count("!") <= n and 2 * n <= chars <= 15 * n


def least_of_each(docs: list[tuple[int, str, str]]) -> list[tuple[int, str, str]]:
    sets = []
    for _, t, _ in docs:
        w = t.encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)})
    group = list(range(len(docs)))
    for x in range(len(docs)):
        for y in range(x):
            if group[x] != group[y] and 100 * len(sets[x] & sets[y]) >= 80 * len(sets[x] | sets[y]):
                old, new = max(group[x], group[y]), min(group[x], group[y])
                group = [new if g == old else g for g in group]
    return [d for i, d in enumerate(docs) if docs[group[i]][0] == d[0]]


def masked(text: str) -> str:
    raw, spans = text.encode(), []
    for r in secret_scan.BASE + secret_scan.MORE:
        spans += [m.span() for m in re.finditer(r.pattern, raw) if m.end(r.group) - m.start(r.group) >= r.least]
    out, end = b"", 0
    for a, b in sorted(spans):
        out += raw[end:a] + b"[secret]" if a >= end else b""
        end = max(end, b)
    return (out + raw[end:]).decode()


def test_near_copies_keep_unlike_rows_of_an_id(spark):
    line = lambda k: " ".join(f"word{k}x{i}" for i in range(40))
    rows = [(7, line(1)), (7, line(2)), (7, line(1)), (8, line(1) + " more"), (9, line(3)), (None, line(4)), (None, line(4)), (None, line(3)), (0, line(5)), (None, line(5)), (3, None), (3, ""), (4, " ")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = Counter((r["doc_id"], r["text"] or "") for r in corpus_pipeline.near_copies(spark, df, None).collect())
    assert got == Counter([(7, line(1)), (7, line(2)), (9, line(3)), (None, line(4)), (0, line(5)), (3, ""), (4, " ")])
    assert corpus_pipeline.near_copies(spark, df.limit(0), None).count() == 0


def mixed(docs: list[tuple[int, str, str]]) -> list[tuple[int, str, int]]:
    sized = [(i, t, s, len(WORD.findall(t))) for i, t, s in docs]
    sizes = Counter()
    for _, _, s, n in sized:
        sizes[s] += n
    out = []
    for s, target in mixing.targets(dict(sizes)).items():
        whole, rest = divmod(round(target), sizes[s])
        upto = 0
        for i, t, n in sorted(((i, t, n) for i, t, x, n in sized if x == s), key=lambda x: hashlib.md5(f"11:{x[0]}".encode()).hexdigest()):
            upto += n
            out.append((i, t, whole + (upto - n / 2 <= rest and rest > 0)))
    return out


def test_the_pipeline_equals_its_plain_version(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    public = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = sorted((r["doc_id"], r["text"] or "", r["source"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    kept = [d for d in docs if passes_rules(d[1])]
    single = least_of_each(kept)
    clean = [(i, masked(t), s) for i, t, s in single]
    assert len(docs) > len(kept) > len(single) and clean != single
    want = Counter()
    for i, t, times in mixed(clean):
        if times:
            want[i] += times * (len(public.encode(t, add_special_tokens=False).ids) + 1)
    got, sequences = Counter(), Counter()
    for r in corpus_pipeline.run(spark, SF).collect():
        got[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]] += r["length"]
    assert got == want
    assert all(n == 1024 for s, n in sequences.items() if s != max(sequences))
