"""Operators on timed sequences: worked cases, and random ones against a sequential model."""

import random

import pytest
from pyspark.sql import functions as F

from tracklane.functions import text as tx
from tracklane.operators import clustering, language, regions, signal, speakers, stitch, tokens, windows
from tracklane.params import RegionParams, ms_to_samples
from tracklane.sources.audio import gaps_filled

BARE = {"min_speech_ms": 0, "min_silence_ms": 0, "speech_pad_ms": 0, "frame_samples": 1600}
S = 16_000
REGION_CASES = [
    ("all silence", [0.0] * 50, {}, 80_000, []),
    ("all speech", [0.9] * 10, {}, 16_000, [(0, 16_000)]),
    ("speech at start", [0.9, 0.9] + [0.0] * 8, {}, 16_000, [(0, 3_200)]),
    ("speech to the end", [0.0] * 3 + [0.9, 0.9], {}, 8_000, [(4_800, 8_000)]),
    ("mid-band dip", [0.9, 0.4, 0.9], {}, 4_800, [(0, 4_800)]),
    ("short silence", [0.9, 0.0, 0.0, 0.9], {"min_silence_ms": 300}, 6_400, [(0, 6_400)]),
    ("long silence", [0.9, 0.0, 0.0, 0.0, 0.9], {"min_silence_ms": 200}, 8_000, [(0, 1_600), (6_400, 8_000)]),
    ("blip", [0.0, 0.9, 0.0, 0.0, 0.0], {"min_speech_ms": 250, "min_silence_ms": 100}, 8_000, []),
    ("pad, clamp", [0.9, 0.0, 0.0], {"speech_pad_ms": 100}, 4_800, [(0, 3_200)]),
    ("pad merges", [0.9, 0.0, 0.9], {"min_silence_ms": 100, "speech_pad_ms": 200}, 4_800, [(0, 4_800)]),
    ("mid-band between lows", [0.9, 0.0, 0.4, 0.0, 0.9], {"min_silence_ms": 300}, 8_000, [(0, 1_600), (6_400, 8_000)]),
    ("not a number holds", [0.9, float("nan"), 0.9, float("nan")], {}, 6_400, [(0, 6_400)]),
    ("short last frame", [0.0, 0.9], {}, 2_000, [(1_600, 2_000)]),
]


def frames_of(spark, cases):
    rows = [(name, i, p, total) for name, ps, total in cases for i, p in enumerate(ps)]
    return spark.createDataFrame(rows, "file_id string, frame long, p double, total long")


@pytest.mark.parametrize("case", REGION_CASES, ids=[c[0] for c in REGION_CASES])
def test_regions(spark, case):
    name, ps, change, total, want = case
    out = regions.regions(frames_of(spark, [(name, ps, total)]), RegionParams(**BARE | change)).orderBy("start_sample").collect()
    assert [(r["start_sample"], r["end_sample"]) for r in out] == want
    assert [r["region_id"] for r in out] == list(range(len(want)))


def model_regions(ps, p: RegionParams, total):
    at = lambda i: min(i * p.frame_samples, total)
    out, opened, quiet = [], None, None
    for i, x in enumerate(ps):
        if x >= p.threshold:
            opened, quiet = (at(i) if opened is None else opened), None
        elif x < p.neg_threshold and opened is not None:
            quiet = i if quiet is None else quiet
            if at(i + 1) - at(quiet) >= ms_to_samples(p.min_silence_ms):
                out.append((opened, at(quiet)))
                opened = quiet = None
    if opened is not None:
        out.append((opened, total))
    pad = ms_to_samples(p.speech_pad_ms)
    out = [(max(0, a - pad), min(total, b + pad)) for a, b in out if b > a and b - a >= ms_to_samples(p.min_speech_ms)]
    merged = []
    for a, b in out:
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(merged[-1][1], b))
        else:
            merged.append((a, b))
    return merged


@pytest.mark.parametrize("change", [{}, {"min_silence_ms": 250, "min_speech_ms": 150, "speech_pad_ms": 120}, {"neg_threshold": 0.7, "min_silence_ms": 150}])
def test_regions_at_random(spark, change):
    luck, p = random.Random(str(change)), RegionParams(**BARE | change)
    cases = {}
    for i in range(400):
        n = luck.randint(1, 40)
        cases[f"f{i}"] = ([luck.choice([0.0, 0.2, 0.4, 0.45, 0.6, 0.9]) for _ in range(n)], n * 1600 - luck.choice([0, 0, 700]))
    df = frames_of(spark, [(k, ps, t) for k, (ps, t) in cases.items()])
    got = {}
    for r in regions.regions(df.repartition(5), p).collect():
        got.setdefault(r["file_id"], []).append((r["start_sample"], r["end_sample"]))
    want = {k: m for k, (ps, t) in cases.items() if (m := model_regions(ps, p, t))}
    assert {k: sorted(v) for k, v in got.items()} == want and want


def regions_of(spark, cases):
    rows = [(k, i, int(a * S), int(b * S)) for k, rs in cases.items() for i, (a, b) in enumerate(rs)]
    return spark.createDataFrame(rows, "file_id string, region_id long, start_sample long, end_sample long")


def planned(spark, cases, probs=None, size=0):
    frames = None if probs is None else spark.createDataFrame([(k, i, p) for k, ps in probs.items() for i, p in enumerate(ps)], "file_id string, frame long, p double")
    out = {}
    for r in windows.windows(regions_of(spark, cases), frames, size).orderBy("file_id", "window_id").collect():
        out.setdefault(r["file_id"], []).append((r["start_sample"] / S, r["end_sample"] / S))
    return out


def test_windows(spark):
    cases = {
        "none": [], "pack": [(0, 5), (7, 12), (15, 20)], "overflow": [(0, 20), (25, 40)], "exact": [(0, 30)], "ninety": [(0, 90)], "hard": [(0, 40)], "tail": [(0, 40), (41, 50), (52, 70)],
        "ceiling": [(0, 10), (11, 29), (30, 95)], "empty": [(3, 3), (4, 6)],
    }
    out = planned(spark, cases)
    assert out == {
        "pack": [(0, 20)], "overflow": [(0, 20), (25, 40)], "exact": [(0, 30)], "ninety": [(0, 30), (30, 60), (60, 90)], "hard": [(0, 30), (30, 40)], "tail": [(0, 30), (30, 50), (52, 70)],
        "ceiling": [(0, 29), (30, 60), (60, 90), (90, 95)], "empty": [(4, 6)],
    }
    quiet = [0.9] * 40
    quiet[28] = 0.1
    assert planned(spark, {"q": [(0, 40)]}, {"q": quiet}, S) == {"q": [(0, 28), (28, 40)]}
    assert planned(spark, {"e": [(0, 40)]}, {"e": [1.0] * 1334}, 480)["e"][0] == (0, 447_840 / S)  # of equals the first


def model_windows(rs, ps, f):
    out, cur = [], None
    for a, b in rs:
        if cur and b - cur[0] <= 480_000:
            cur = (cur[0], b)
            continue
        if cur:
            out.append(cur)
        while b - a > 480_000:
            part = ps[(a + 448_000) // f : (a + 480_000) // f]
            cut = ((a + 448_000) // f + part.index(min(part))) * f if part else a + 480_000
            out.append((a, cut if cut > a else a + 480_000))
            a = out[-1][1]
        cur = (a, b)
    return [*out, cur] if cur else out


def test_windows_at_random(spark):
    luck, cases, probs, want = random.Random(3), {}, {}, {}
    for i in range(150):
        at, rs = 0.0, []
        for _ in range(luck.randint(1, 8)):
            at += luck.randint(1, 12)
            end = at + luck.choice([2, 9, 14, 31, 45, 100])
            rs.append((at, end))
            at = end
        ps = [luck.choice([0.1, 0.5, 0.9]) for _ in range(int(at) - luck.choice([0, 0, 20]))]
        cases[f"f{i}"], probs[f"f{i}"] = rs, ps
        want[f"f{i}"] = [(a / S, b / S) for a, b in model_windows([(int(a * S), int(b * S)) for a, b in rs], ps, S)]
    assert planned(spark, cases, probs, S) == want


def test_windows_are_filled_with_silence(spark):
    signals = spark.createDataFrame([("a", [0.5] * (3 * S))], "file_id string, samples array<float>")
    plan = regions_of(spark, {"a": [(2, 9)]}).select("file_id", F.lit(0).alias("window_id"), "start_sample", "end_sample")
    r = windows.materialised(plan, signals).first()
    assert (r["offset"], r["real_len"], len(r["samples"])) == (2 * S, S, 480_000) and sum(r["samples"]) == S / 2


def test_stitching(spark):
    W = "file_id string, window_id long, offset_us long, real_us long"
    G = "file_id string, window_id long, seg_id long, start_us long, end_us long, text string, words array<struct<start_us: long, end_us: long, word: string, probability: double>>"
    spans = spark.createDataFrame([("f", 0, 0, 10_000_000), ("f", 1, 60_000_000, 30_000_000)], W)
    w = lambda a, b, t="x": {"start_us": a, "end_us": b, "word": t, "probability": 1.0}
    rows = [
        ("f", 1, 0, 1_000_000, 2_500_000, "shift", None), ("f", 0, 0, 2_000_000, 4_000_000, "kept", [w(1_000_000, 1_500_000), w(9_500_000, 12_000_000), w(12_000_000, 13_000_000)]), ("f", 0, 1, 12_000_000, 14_000_000, "padding", None),
        ("f", 0, 2, 9_000_000, 25_000_000, "clamp", [w(12_000_000, 13_000_000)]), ("f", 0, 3, 1, 2, " \t  　\u0085 ", None), ("f", 0, 4, 5, 6, "empty list", []),
    ]
    out = {r["text"]: r for r in stitch.stitched(spans, spark.createDataFrame(rows, G)).collect()}
    assert set(out) == {"shift", "kept", "clamp", "empty list"}
    assert (out["shift"]["start_us"], out["shift"]["end_us"]) == (61_000_000, 62_500_000)
    assert out["clamp"]["end_us"] == 10_000_000 and out["clamp"]["words"] is None and out["empty list"]["words"] is None
    assert [x["end_us"] for x in out["kept"]["words"]] == [1_500_000, 10_000_000]
    ids = stitch.numbered(spark.createDataFrame(rows, G), "window_id", "seg_id").orderBy("id").collect()
    assert [r["id"] for r in ids] == list(range(6))


SEC = 1_000_000
TURN_CASES = [
    ("majority", [(0, 1.2, 7), (1.2, 3, 9)], (1, 2), 9), ("uncovered", [(10, 12, 1)], (0, 1), None), ("none", [], (0, 1), None), ("tie by start", [(1.5, 2, 4), (1, 1.5, 2)], (1, 2), 2),
    ("accumulate", [(0, 0.3, 3), (0.3, 0.6, 3), (0.6, 1.1, 5)], (0, 1), 3), ("zero length", [(0, 5, 1)], (2, 2), None), ("backwards turn", [(5, 1, 8), (0, 1, 2)], (0, 1), 2), ("tie by id", [(0, 2, 7), (0, 2, 3)], (0, 2), 3),
    ("touching", [(0, 1, 1)], (1, 2), None), ("across bins", [(50, 70, 1), (61, 200, 2)], (59, 130), 2),
]


def test_words_go_to_the_speaker_who_covers_them_most(spark):
    for width in (60 * SEC, 700_000):
        words = spark.createDataFrame([(n, 0, int(a * SEC), int(b * SEC)) for n, _, (a, b), _ in TURN_CASES], "file_id string, word_id long, start_us long, end_us long")
        turns = spark.createDataFrame([(n, int(a * SEC), int(b * SEC), s) for n, ts, _, _ in TURN_CASES for a, b, s in ts], "file_id string, start_us long, end_us long, speaker long")
        got = {r["file_id"]: r["speaker"] for r in speakers.assigned(words, turns, bin_us=width).collect()}
        assert got == {n: s for n, _, _, s in TURN_CASES if s is not None}


def test_words_at_random(spark):
    luck, words, turns, want = random.Random(8), [], [], {}
    for f in range(120):
        ts = [(a := luck.randint(0, 60), a + luck.randint(-2, 20), luck.randint(0, 3)) for _ in range(luck.randint(0, 6))]
        turns += [(f, a, b, s) for a, b, s in ts]
        for k in range(6):
            a = luck.randint(0, 70)
            b = a + luck.randint(0, 9)
            words.append((f, k, a, b))
            totals = {}
            for x, y, s in ts:
                if (o := min(b, y) - max(a, x)) > 0:
                    n, first = totals.get(s, (0, 99))
                    totals[s] = (n + o, min(first, x))
            want[f, k] = min(totals, key=lambda s: (-totals[s][0], totals[s][1], s)) if totals else None
    got = speakers.assigned(spark.createDataFrame(words, "file_id long, word_id long, start_us long, end_us long"), spark.createDataFrame(turns, "file_id long, start_us long, end_us long, speaker long"), bin_us=13)
    assert {(r["file_id"], r["word_id"]): r["speaker"] for r in got.collect()} == {k: v for k, v in want.items() if v is not None}


def test_segments_split_where_the_speaker_changes(spark):
    kind = "array<struct<start_us: long, end_us: long, word: string, probability: double>>"
    w = lambda a, b, t: {"start_us": int(a * SEC), "end_us": int(b * SEC), "word": t, "probability": 1.0}
    rows = [
        ("one", 0, 0, 2 * SEC, "as it was", [w(0, 1, "as"), w(1, 2, "it")]), ("two", 0, 0, 3 * SEC, "a b c", [w(0, 1, "a"), w(1, 2, "b"), w(2, 3, ",")]), ("gap", 0, 0, 3 * SEC, "x y z", [w(0, 1, "x"), w(1, 2, "y"), w(2, 3, "z")]),
        ("null", 0, 0, SEC, "t", None), ("empty", 0, 0, SEC, "t", []),
    ]
    segments = spark.createDataFrame(rows, f"file_id string, seg_id long, start_us long, end_us long, text string, words {kind}")
    turns = spark.createDataFrame([("one", 0, 5 * SEC, 1), ("two", 0, SEC, 1), ("two", SEC, 3 * SEC, 2), ("gap", 0, SEC, 1), ("gap", 2 * SEC, 3 * SEC, 1), ("null", 0, 5 * SEC, 1), ("empty", 0, 5 * SEC, 1)], "file_id string, start_us long, end_us long, speaker long")
    out = {}
    for r in speakers.split_segments(segments, turns).orderBy("file_id", "run").collect():
        out.setdefault(r["file_id"], []).append((r["start_us"] / SEC, r["end_us"] / SEC, r["text"], r["speaker"], None if r["words"] is None else len(r["words"])))
    assert out == {
        "one": [(0, 2, "as it was", 1, 2)], "two": [(0, 1, "a", 1, 1), (1, 3, "b,", 2, 2)], "gap": [(0, 1, "x", 1, 1), (1, 2, "y", None, 1), (2, 3, "z", 1, 1)], "null": [(0, 1, "t", None, None)], "empty": [(0, 1, "t", None, 0)],
    }
    assert {r["speaker"] for r in speakers.split_segments(segments, None).collect()} == {None}
    files = spark.createDataFrame([("one",), ("two",), ("silent",)], "file_id string")
    assert {r[0]: r[1] for r in speakers.speaker_counts(files, turns).collect()} == {"one": 1, "two": 2, "silent": 0}


def test_joined_words(spark):
    cases = [(["He", "said", ",", "it", "'s", "fine", ".", "Ok"], "He said, it's fine. Ok"), ([], ""), (["one"], "one"), ([".", "next"], ". next"), (["a", "", "b"], "a b"), (["a", "’s"], "a’s")]
    df = spark.createDataFrame([(w, t) for w, t in cases], "w array<string>, t string")
    assert all(r[0] == r[1] for r in df.select(tx.join_words(F.col("w")), "t").collect())


def test_tokens_and_codes(spark):
    cases = [("<|en|>", "en", None), ("en", "en", None), ("<|en", "<|en", None), ("<|>", "<|>", None), ("<en>", "<en>", "en"), ("<en-US>", "<en-US>", "en-US"), ("<EN>", "<EN>", None), ("<eng>", "<eng>", None), ("<en>\n", "<en>\n", None), ("<en-us>", "<en-us>", None)]
    df = spark.createDataFrame([(t,) for t, _, _ in cases], "t string").select("t", tx.strip_token(F.col("t")), tx.language_tag(F.col("t")))
    assert [tuple(r) for r in df.collect()] == cases
    codes = spark.createDataFrame([("en",), ("EN-us",), ("en_GB",), ("eng",), ("fr",)], "c string").select(tx.is_english(F.col("c"))).collect()
    assert [r[0] for r in codes] == [True, True, True, False, False]
    pick = spark.createDataFrame([("a", "b"), (None, "b"), ("a", None), (None, None)], "x string, y string").select(tx.chosen_language(F.col("x"), F.col("y"))).collect()
    assert [r[0] for r in pick] == ["a", "b", "a", None]
    told = spark.createDataFrame([("fr", False), ("auto", True), ("en-US", True)], "c string, e boolean").select(tx.target_language(F.col("c"), F.col("e"))).collect()
    assert [r[0] for r in told] == ["fr", None, None]
    with pytest.raises(Exception, match="English only"):
        spark.createDataFrame([("fr", True)], "c string, e boolean").select(tx.target_language(F.col("c"), F.col("e"))).collect()


def test_one_language_per_file(spark):
    files = spark.createDataFrame([("a",), ("b",)], "file_id string")
    scores = spark.createDataFrame([("a", 1, "fr", 0.9), ("a", 0, "de", 0.4), ("a", 0, "es", 0.5)], "file_id string, window_id long, language string, probability double")
    assert {tuple(r) for r in language.file_language(files, scores).collect()} == {("a", "es", 0.5), ("b", "unknown", None)}
    assert {tuple(r) for r in language.file_language(files, scores, "it").collect()} == {("a", "it", None), ("b", "it", None)}
    emitted = spark.createDataFrame([("a", 2, "<fr>", -1.0), ("a", 1, "hi", -1.0), ("a", 3, "<de>", 0.0), ("b", 0, "x", 0.0)], "file_id string, pos long, piece string, logprob double")
    got = {r[0]: (r[1], round(r[2], 4)) for r in language.tagged_language(emitted).collect()}
    assert got == {"a": ("fr", 0.3679), "b": ("unknown", 0.0)}
    assert {tuple(r)[1:] for r in language.tagged_language(emitted, english_only=True).collect()} == {("en", 1.0)}


def test_dense_labels_and_clusters(spark):
    cases = {"a": [0, 2, 2, 5], "b": [7, 3, 7, 9, 3], "c": [0, 1, 2]}
    df = spark.createDataFrame([(k, i, x) for k, v in cases.items() for i, x in enumerate(v)], "file_id string, pos long, label long")
    got = {}
    for r in clustering.dense_labels(df).orderBy("file_id", "pos").collect():
        got.setdefault(r["file_id"], []).append(r["dense"])
    assert got == {"a": [0, 1, 1, 2], "b": [0, 1, 0, 2, 1], "c": [0, 1, 2]}
    vectors = spark.createDataFrame([("x", i, [float(i % 3 * 10), float(i % 2) / 9]) for i in range(12)] + [("y", 0, [1.0, 1.0]), ("y", 1, [5.0, 5.0])], "file_id string, pos long, vector array<double>")
    out = {}
    for r in clustering.clustered(vectors, 3).orderBy("file_id", "pos").collect():
        out.setdefault(r["file_id"], []).append(r["label"])
    assert out == {"x": [0, 1, 2] * 4, "y": [0, 1]}
    assert clustering.clustered(vectors.limit(0), 3).count() == 0 and len(clustering.k_means(clustering.np.zeros((4, 2)), 3)) == 4


def test_samples(spark):
    xs = [(0.0, 0), (1.5, 32767), (-2.0, -32767), (0.5, 16383), (-0.00009, -2)]
    got = spark.createDataFrame([(x,) for x, _ in xs], "x double").select(signal.quantized(F.col("x"))).collect()
    assert [r[0] for r in got] == [y for _, y in xs]
    signals = spark.createDataFrame([("a", [0.0] * 1600 + [0.8] * 3200 + [0.0] * 800), ("b", [])], "file_id string, samples array<float>")
    frames = signal.framed(signals, 1600)
    assert all(len(r["samples"]) == 1600 for r in frames.collect())
    assert [(r["frame"], r["p"]) for r in signal.magnitude_scores(frames).orderBy("frame").collect()] == [(0, 0.0), (1, 0.9), (2, 0.9), (3, 0.0)]
    np = signal.np
    x = np.sin(np.arange(8000) * 2 * np.pi * 440 / 8000).astype(np.float32)
    assert len(signal.resampled(x, 8000)) == 16000 and abs(np.abs(signal.resampled(x, 8000)).max() - 1) < 0.02
    assert signal.resampled(x, 16000) is not None and len(signal.resampled(x[:500], 44100)) == 181 and len(signal.resampled(x[:0], 8000)) == 0
    assert signal.mixed_down(np.array([1, 3, 5, 7, 9], np.float32), 2).tolist() == [2, 6]
    mel = signal.log_mel(signal.resampled(x, 8000), 80, most=120)
    assert mel.shape == (80, 120) and (mel[:, :2] == 0).all() and (mel[:, 2] != 0).any() and (mel[:, 100:] == 0).all()
    peak = mel[:, 50].argmax()
    assert 8 <= peak <= 14  # 440 Hz


def test_resampled_and_mel_values():
    np = signal.np
    at = lambda rate, n: (0.6 * np.sin(np.arange(n) * 2 * np.pi * 300 / rate) + 0.3 * np.cos(np.arange(n) * 2 * np.pi * 1900 / rate)).astype(np.float32)
    for rate in (8000, 22050, 44100, 48000):
        out = signal.resampled(at(rate, rate // 2), rate)
        assert np.abs(out - at(16000, len(out)))[400:-400].max() < 2e-3, rate
    x, n_fft, hop = at(16000, 3000), 400, 160
    got = signal.log_mel(x, 40, most=18)
    hann = [0.5 - 0.5 * np.cos(2 * np.pi * k / n_fft) for k in range(n_fft)]
    filters = signal.mel_filters(40)
    for column in (2, 9, 18 - 1):
        part = x[(column + 1) * hop - n_fft : (column + 1) * hop].astype(float) * hann
        power = [abs(sum(part * np.exp(-2j * np.pi * f * np.arange(n_fft) / n_fft))) ** 2 for f in range(n_fft // 2 + 1)]
        logs = np.log10(np.maximum([sum(w * p for w, p in zip(row, power, strict=True)) for row in filters], 1e-10))
        assert np.abs(got[:, column] - (np.maximum(logs, logs.max() - 8) + 4) / 4).max() < 1e-4


def test_windows_are_materialised(spark):
    planned = spark.createDataFrame([("a", 0, 0, 40), ("a", 1, 40, 100), ("a", 2, 70, 90)], "file_id string, window_id long, start_sample long, end_sample long")
    files = spark.createDataFrame([("a", [float(i) for i in range(64)])], "file_id string, samples array<float>")
    out = windows.materialised(planned, files).orderBy("window_id").collect()
    assert [(r["offset"], r["real_len"], len(r["samples"])) for r in out] == [(0, 40, 480000), (40, 24, 480000), (70, 0, 480000)]
    assert out[1]["samples"][:25] == [float(i) for i in range(40, 64)] + [0.0] and not any(out[2]["samples"])


def test_many_vectors_are_clustered_without_all_distances(monkeypatch):
    import tracemalloc

    np = signal.np
    luck = np.random.default_rng(5)
    cases = [(luck.normal(0, 1, (n, 4)), most) for n in (1, 2, 40, 200) for most in (None, 3)]
    want = [clustering.agglomerated(x, most).tolist() for x, most in cases]
    many = luck.normal(0, 1, (2500, 8))
    tracemalloc.start()
    labels = clustering.agglomerated(many, 4)
    most_held = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most_held < 8 * len(many) ** 2 and len(set(labels.tolist())) <= 4
    monkeypatch.setattr(clustering, "HELD", 0, raising=False)
    assert [clustering.agglomerated(x, most).tolist() for x, most in cases] == want


def test_clusters_stay_apart_by_mean_distance(spark):
    np = signal.np
    luck = np.random.default_rng(4)

    def plain(x, most, apart=0.45):
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        groups = [[i] for i in range(len(x))]
        while len(groups) > 1:
            d, a, b = min((np.mean([1 - unit[i] @ unit[j] for i in groups[a] for j in groups[b]]), a, b) for a in range(len(groups)) for b in range(a + 1, len(groups)))
            if d > apart and len(groups) <= (most or len(x)):
                break
            groups[a] += groups.pop(b)
        order = {}
        return [order.setdefault(next(k for k, g in enumerate(groups) if i in g), len(order)) for i in range(len(x))]

    for most in (None, 2):
        for _ in range(15):
            x = luck.normal(0, 1, (12, 3))
            assert clustering.agglomerated(x, most).tolist() == plain(x, most)
    assert clustering.agglomerated(np.zeros((0, 3))).tolist() == [] and clustering.agglomerated(np.array([[1.0, 0], [5, 0], [0, 2]])).tolist() == [0, 0, 1]
    df = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("a", 1, [0.0, 1.0]), ("a", 2, [2.0, 0.1]), ("b", 0, [3.0, 3.0])], "file_id string, pos long, vector array<double>")
    assert {(r["file_id"], r["pos"]): r["label"] for r in clustering.clustered(df, None).collect()} == {("a", 0): 0, ("a", 1): 1, ("a", 2): 0, ("b", 0): 0}


def test_tokens_become_a_segment(spark):
    rows = [("a", 0, 2, 50, 60, "c"), ("a", 0, 1, 70, 95, "b"), ("a", 0, 0, 10, 20, None), ("a", 1, 5, 1, 2, "x")]
    df = spark.createDataFrame(rows, "file_id string, window_id long, pos long, start_us long, end_us long, piece string")
    out = tokens.token_segments(df).orderBy("window_id").collect()
    assert [(r["start_us"], r["end_us"], r["text"], len(r["words"]), r["seg_id"]) for r in out] == [(10, 60, " b c", 3, 0), (1, 2, "x", 1, 0)]
    assert all(w["probability"] == 1.0 for r in out for w in r["words"])
    assert {r["words"] for r in tokens.token_segments(df, words=False).collect()} == {None} and tokens.token_segments(df.limit(0)).count() == 0


def test_gaps_are_silence(spark):
    df = spark.createDataFrame([("a", 0, 0.9, 8000), ("a", 3, 0.8, 8000)], "file_id string, frame long, p double, total long")
    assert [(r["frame"], r["p"]) for r in gaps_filled(df).orderBy("frame").collect()] == [(0, 0.9), (1, 0.0), (2, 0.0), (3, 0.8)]


def test_totals(spark):
    files = spark.createDataFrame([("a", 40 * S), ("b", 10 * S)], "file_id string, total long")
    out = {r[0]: (r[1], r[2]) for r in regions.totals(files, regions_of(spark, {"a": [(0, 10), (20, 35)]})).collect()}
    assert out == {"a": (40.0, 25.0), "b": (10.0, 0.0)}
    assert regions.whole_files(files).count() == 2
