"""From audio files to segments with a fake recogniser; parameters, model directories, streaming."""

import json
import struct
from fractions import Fraction

import numpy as np
import pytest

from tracklane import params
from tracklane.errors import AudioEmpty, AudioError, BackendError, DownloadError, ModelNotFound, RuntimeMissing
from tracklane.operators import regions
from tracklane.plans import backends, conversion, registry, runtime
from tracklane.plans.transcription import SpeechModel, StreamingModel
from tracklane.sources import containers
from tracklane.sources.audio import decoded, signals
from tracklane.streaming.regions import region_stream

RATE = 16_000


def wav(samples: np.ndarray, rate: int = RATE, channels: int = 1, code: int = 1, bits: int = 16) -> bytes:
    body = (np.repeat(samples, channels) * 32767).astype("<i2").tobytes() if code == 1 else np.repeat(samples, channels).astype("<f4").tobytes()
    head = struct.pack("<HHIIHH", code, channels, rate, rate * channels * bits // 8, channels * bits // 8, bits)
    return b"RIFF" + struct.pack("<I", 36 + len(body)) + b"WAVEfmt " + struct.pack("<I", 16) + head + b"data" + struct.pack("<I", len(body)) + body


def tone(seconds: float, rate: int = RATE, hertz: int = 440, level: float = 0.5) -> np.ndarray:
    return (level * np.sin(np.arange(int(seconds * rate)) * 2 * np.pi * hertz / rate)).astype(np.float32)


class Echo:
    """Hears a word each half second for as long as it is loud, and one in the padding."""

    def __init__(self, *args):
        self.args = args

    def transcribe(self, samples, language, words):
        n = max(1, int((np.abs(samples) > 0.1).nonzero()[0].max() / RATE * 2)) if (np.abs(samples) > 0.1).any() else 0
        listed = [{"start": i / 2, "end": i / 2 + 0.4, "word": f"w{i}", "probability": 0.5} for i in range(n)]
        out = [{"start": 0.0, "end": n / 2, "text": f"{language} heard {n}", "words": listed if words else None}] if n else []
        return [*out, {"start": 30.0, "end": 31.0, "text": "invented", "words": None}, {"start": 0.0, "end": 1.0, "text": "  ", "words": None}]

    def detect_language(self, samples):
        return "de", 0.75


@pytest.fixture
def backend():
    backends.register("recogniser", Echo)
    backends.register("diariser", backends.ByBand)
    yield
    backends.register("recogniser", None)
    backends.register("diariser", None)


@pytest.fixture
def model_dir(tmp_path):
    path = tmp_path / "model"
    path.mkdir()
    for f in (*registry.WINDOWED_FILES, "tokenizer.json", *registry.STREAMING_FILES):
        (path / f).write_text("{}")
    return str(path)


def test_decoding():
    for rate, channels, code, bits in ((RATE, 1, 1, 16), (44_100, 2, 1, 16), (44_100, 1, 3, 32)):
        got, samples = decoded(wav(tone(1, rate), rate, channels, code, bits))
        assert got == rate and len(samples) == rate and 0.3 < np.abs(samples).max() <= 1
    with pytest.raises(AudioError, match="truncated"):
        decoded(wav(tone(1))[:9000])
    with pytest.raises(AudioEmpty):
        decoded(wav(tone(0)))
    with pytest.raises(AudioError, match="not a WAV"):
        decoded(b"ID3 something else entirely")
    assert issubclass(AudioError, ValueError) and issubclass(ModelNotFound, OSError) and issubclass(BackendError, RuntimeError)


class Boxed:
    """A container for tests: a track of pictures, then sound in packets of 100 ticks, one of them broken."""

    tracks = (containers.Track(0, False), containers.Track(1, True, RATE, Fraction(1, 1000)), containers.Track(2, True, 8000))

    def __init__(self, content: bytes, path: str):
        self.ends_early = content == b"early"

    def packets(self):
        yield containers.Packet(0, 100, b"picture")
        yield containers.Packet(1, 100, b"1")
        yield containers.Packet(2, 100, b"1")
        yield containers.Packet(1, 33, b"broken")
        if self.ends_early:
            raise EOFError("no more bytes")
        yield containers.Packet(1, 100, b"2")

    def decode(self, packet):
        if packet.data == b"broken":
            raise containers.CorruptPacket("bad sync")
        return np.full(2 * packet.ticks * RATE // 1000, float(packet.data) / 4, np.float32), 2


@pytest.fixture
def boxed():
    containers.register_container("BOX", Boxed)
    yield
    containers.register_container("box", None)


def test_containers(spark, tmp_path, boxed):
    rate, samples = decoded(b"whole", "a.Box")
    assert rate == RATE and len(samples) == 1600 + 528 + 1600 and (samples[:1600] == 0.25).all() and not samples[1600:2128].any() and (samples[2128:] == 0.5).all()
    with pytest.raises(AudioError, match="no more bytes"):
        decoded(b"early", "a.box")
    with pytest.raises(AudioError, match="nothing is registered"):
        decoded(b"whole", "a.unknown")
    (tmp_path / "x.box").write_bytes(b"whole")
    assert [len(r["samples"]) for r in signals(spark, str(tmp_path / "x.box")).collect()] == [3728]

    class Other:
        def __init__(self, *tracks):
            self.tracks = tracks

        def packets(self):
            return [containers.Packet(1, 7)]

        def decode(self, packet):
            raise containers.CorruptPacket

    assert len(containers.read(Other(containers.Track(1, True, RATE)))[1]) == 7  # without a tick, lengths are in frames
    for tracks in ((), (containers.Track(1, False),), (containers.Track(3, True, RATE),)):
        with pytest.raises(AudioEmpty):
            containers.read(Other(*tracks))
    with pytest.raises(AudioError, match="sample rate"):
        containers.read(Other(containers.Track(1, True)))


def test_scorers():
    noise = np.random.default_rng(2).normal(0, 0.01, 3 * RATE).astype(np.float32)
    x = np.concatenate([noise, tone(2) + noise[: 2 * RATE], noise[:RATE]])
    p = backends.Gate().probabilities(x)
    assert set(p) == {0.0, 1.0} and len(p) == -(-len(x) // 480) and p[100:].sum() == pytest.approx(2 * RATE / 480, abs=4)
    assert not backends.Gate().probabilities(np.zeros(1000, np.float32)).any() and len(backends.Gate().probabilities(np.zeros(0, np.float32))) == 0
    assert backends.Gate().probabilities(tone(60)).all()  # a long sound doesn't become noise
    assert not backends.Gate.graded and backends.Loudness.graded and backends.factory("scorer") is backends.Gate


def test_backends_are_told_apart():
    a, b = (lambda k: lambda: ("made", k))(1), (lambda k: lambda: ("made", k))(2)
    assert backends._backend(a) == ("made", 1) and backends._backend(b) == ("made", 2)
    assert backends._backend(a) is backends._backend(a)


def test_embedded_diariser():
    x = np.concatenate([tone(2, hertz=200), tone(2, hertz=1500), tone(1, hertz=200)])
    assert backends.ByBand().turns(x, 8, None) == [(0.0, 2.0, 0), (2.0, 4.0, 1), (4.0, 5.0, 0)]
    assert backends.ByBand().turns(x, 8, 1) == [(0.0, 5.0, 0)] and backends.ByBand().turns(x, 1, None) == [(0.0, 5.0, 0)]
    assert backends.ByBand().turns(np.zeros(100, np.float32), 8, None) == []


def test_sample_arrays():
    import pyarrow as pa

    from tracklane.operators.signal import arrays

    column = pa.array([[1.0, 2.0], None, [], [3.0]], pa.list_(pa.float32()))
    assert [x.tolist() for x in arrays(column)] == [[1, 2], [], [], [3]] and [x.tolist() for x in arrays(column.slice(2))] == [[], [3]]


def test_files_are_fetched_one_by_one(tmp_path):
    asked = []

    def get(repo, name):
        asked.append(name)
        if name.endswith(("vocabulary.json", "encoder.onnx.data")):
            raise FileNotFoundError(name)
        if name.endswith("vocabulary.txt"):
            raise OSError("connection lost")
        to = tmp_path / repo / name
        to.parent.mkdir(parents=True, exist_ok=True)
        to.write_text("{}")
        return str(to)

    assert registry.ensure_model("owner/name", fetch=registry.fetcher(get)) == str(tmp_path / "owner/name")
    assert asked == [*registry.WINDOWED_FILES, *registry.WINDOWED_EXTRAS]
    asked.clear()
    path = registry.ensure_model("nemotron", streaming=True, fetch=registry.fetcher(get, streaming=True))
    assert path.endswith(registry.ALIASES["nemotron"][1]) and len(asked) == 4

    def refuse(repo, name):
        raise FileNotFoundError(name)

    with pytest.raises(DownloadError, match="model.bin"):
        registry.ensure_model("tiny", fetch=registry.fetcher(refuse))


def test_feature_settings(tmp_path):
    registry.ensure_features(str(tmp_path), "tiny")
    made = registry.feature_settings(str(tmp_path))
    assert (made.feature_size, made.hop_length, made.n_fft, made.nb_max_frames, made.sampling_rate) == (80, 160, 400, 3000, RATE) and made.mel_filters.shape == (80, 201)
    file = tmp_path / "preprocessor_config.json"
    given = json.loads(file.read_text())
    file.write_text(json.dumps(given | {"mel_filters": [[1.0, 2.0], [3.0, 4.0]]}))
    assert registry.feature_settings(str(tmp_path)).mel_filters.tolist() == [[1, 2], [3, 4]]
    for wrong in (json.dumps(given | {"mel_filters": [[1.0], [3.0, 4.0]]}), "{}", "no json"):
        file.write_text(wrong)
        with pytest.raises(BackendError):
            registry.feature_settings(str(tmp_path))


def test_converter_and_its_command_line(tmp_path, monkeypatch, capsys):
    tool = tmp_path / "bin" / conversion.CONVERTER
    tool.parent.mkdir()
    tool.write_text('#!/bin/sh\necho "$@" > "$4.args"; [ "$2" = bad ] && { echo wrong model >&2; exit 3; }; mkdir -p "$4"\n')
    tool.chmod(0o755)
    monkeypatch.setenv("PATH", f"{tool.parent}:/usr/bin:/bin")
    out = str(tmp_path / "out")
    assert conversion.main(["m", out, "--quantization", "int8"]) == 0 and capsys.readouterr().out.strip() == out
    assert open(out + ".args").read().split() == ["--model", "m", "--output_dir", out, "--quantization", "int8"]
    assert conversion.main(["m", out]) == 1 and "force" in capsys.readouterr().err
    assert conversion.convert_model("m", out, force=True) == out
    assert conversion.main(["bad", str(tmp_path / "new")]) == 1 and "wrong model" in capsys.readouterr().err


def test_logging_leaves_the_programs_own(monkeypatch):
    import logging

    from tracklane import logs

    own, root = logging.getLogger("tracklane"), logging.getLogger()
    monkeypatch.setattr(root, "handlers", [])
    monkeypatch.setattr(own, "handlers", [])
    try:
        assert logs.start_logging("error,tracklane.plans=debug,odd=loud") and own.level == logging.ERROR and logging.getLogger("tracklane.plans").level == logging.DEBUG
        assert not logs.start_logging()
    finally:
        own.setLevel(logging.NOTSET)
        logging.getLogger("tracklane.plans").setLevel(logging.NOTSET)


def test_runtime_library(tmp_path, monkeypatch):
    capi = tmp_path / "onnxpackage" / "capi"
    capi.mkdir(parents=True)
    (capi.parent / "__init__.py").write_text("raise ImportError('not to be imported')")
    for name in ("libonnxruntime.so.1.29.0", "libonnxruntime.1.28.0.dylib", "onnxruntime_pybind11_state.so", "onnxruntime_validation.py"):
        (capi / name).write_text("")
    monkeypatch.syspath_prepend(str(tmp_path))
    monkeypatch.delenv(runtime.VARIABLE, raising=False)
    found = runtime.packaged("onnxpackage")
    assert [p.rpartition("/")[2] for p in found] == ["libonnxruntime.1.28.0.dylib", "libonnxruntime.so.1.29.0"] and runtime.packaged("no_such_package") == []
    assert runtime.runtime_library(lambda: ["/nowhere/x.so", found[1]]) == found[1]
    for wrong in (list, lambda: ["/nowhere/x.so"]):
        with pytest.raises(RuntimeMissing, match="install"):
            runtime.runtime_library(wrong)
    monkeypatch.setenv(runtime.VARIABLE, found[0])

    def unasked():
        raise AssertionError("candidates are looked for although a library is named")

    assert runtime.runtime_library(unasked) == found[0]
    monkeypatch.setenv(runtime.VARIABLE, "/nowhere/y.so")
    with pytest.raises(OSError, match="nowhere"):
        runtime.runtime_library()
    calls = []
    for _ in range(2):
        assert runtime.loaded_once(lambda p: calls.append(p) or True, found[0]) == found[0]
        with pytest.raises(RuntimeMissing):
            runtime.loaded_once(lambda p: calls.append(p), found[1])
    assert calls == found


def test_time_marks_are_rounded():
    index = lambda x: params.DecodeOptions(max_initial_timestamp=x).max_initial_timestamp_index
    assert [index(x) for x in (1.0, 0.0, 0.01, 0.0099, 2.5)] == [50, 0, 1, 0, 125]


def test_signals_are_resampled(spark, tmp_path):
    (tmp_path / "a.wav").write_bytes(wav(tone(1, 44_100), 44_100, 2))
    (tmp_path / "b.wav").write_bytes(wav(tone(0.5)))
    rows = sorted(signals(spark, str(tmp_path)).collect(), key=lambda r: r["file_id"])
    assert [len(r["samples"]) for r in rows] == [16_000, 8_000] and {r["sample_rate"] for r in rows} == {RATE}


def test_transcription(spark, tmp_path, backend, model_dir):
    quiet = np.zeros(3 * RATE, np.float32)
    (tmp_path / "a.wav").write_bytes(wav(np.concatenate([quiet, tone(4), quiet, quiet, tone(40), quiet])))
    model = SpeechModel(model_dir, spark=spark)
    assert json.load(open(f"{model.model_path}/preprocessor_config.json"))["feature_size"] == 80
    found, info = model.transcribe(str(tmp_path / "a.wav"), vad_parameters={"speech_pad_ms": 0})
    out = list(found)
    assert info.language == "de" and info.language_probability == 0.75 and info.duration == pytest.approx(56) and info.duration_after_vad == pytest.approx(44, abs=0.1) and info.num_speakers is None
    assert [s.id for s in out] == list(range(len(out))) and len(out) == 3 and all(s.words is None and s.speaker is None for s in out)
    assert out[0].start == pytest.approx(3, abs=0.05) and all(a.start < b.start for a, b in zip(out, out[1:], strict=False)) and "de heard" in out[0].text
    found, info = model.transcribe(str(tmp_path / "a.wav"), language="fr", vad_filter=False)
    assert info.language == "fr" and info.language_probability is None and info.duration_after_vad == info.duration
    assert [s.start for s in found] == [0.0, 30.0]
    with pytest.raises(AudioError, match="several"):
        (tmp_path / "b.wav").write_bytes(wav(tone(1)))
        model.transcribe(str(tmp_path / "*.wav"))
    assert repr(out[0]).startswith("Segment(id=0, start=3.00")


def test_speakers_in_the_dataflow(spark, tmp_path, backend, model_dir):
    (tmp_path / "a.wav").write_bytes(wav(np.concatenate([tone(4, hertz=200), tone(4, hertz=1500)])))
    found, info = SpeechModel(model_dir, spark=spark).transcribe(str(tmp_path / "a.wav"), diarize=True, num_speakers=2)
    out = list(found)
    assert info.num_speakers == 2 and [s.speaker for s in out] == [0, 1] and [s.id for s in out] == [0, 1]
    assert all(w.speaker == s.speaker for s in out for w in s.words) and out[0].end <= out[1].start


def test_many_files_and_a_silent_one(spark, backend, model_dir):
    rows = [("loud", RATE, tone(2).tolist()), ("silent", RATE, [0.0] * RATE), ("empty", RATE, [])]
    files = spark.createDataFrame(rows, "file_id string, sample_rate int, samples array<float>")
    segments, info = StreamingModel(model_dir, spark=spark, target_lang="es").transcribe(files)
    assert {r["file_id"] for r in segments.collect()} == {"loud"}
    assert {r["file_id"]: r["language"] for r in info.collect()} == {"loud": "es", "silent": "es", "empty": "es"}
    _, info = StreamingModel(model_dir, spark=spark).transcribe(files)
    assert {r["file_id"]: (r["language"], r["language_probability"]) for r in info.collect()} == {"loud": ("de", 0.75), "silent": ("unknown", None), "empty": ("unknown", None)}


def test_no_backend_is_an_error(spark, model_dir):
    with pytest.raises(BackendError, match="no recogniser is registered"):
        SpeechModel(model_dir, spark=spark).transcribe(spark.createDataFrame([], "file_id string, sample_rate int, samples array<float>"))


def test_parameters(spark, backend, model_dir):
    model = SpeechModel(model_dir, spark=spark)
    for wrong, match in (({"task": "translate"}, "translate"), ({"vad_parameters": {"not_a_key": 1}}, "not_a_key"), ({"max_speakers": 3}, "max_speakers"), ({"num_speakers": 2}, "num_speakers"), ({"diarize": True, "word_timestamps": False}, "word_timestamps")):
        with pytest.raises(ValueError, match=match):
            model.transcribe("x.wav", **wrong)
    for most, k in ((256, None), (0, None), (8, 0), (4, 5)):
        with pytest.raises(BackendError):
            params.checked_speakers(True, most, k)
    with pytest.warns(UserWarning, match="idle"):
        params.RegionParams.of({"threshold": 0.7})
    assert params.RegionParams.of({"min_silence_duration_ms": 5}, True).min_silence_ms == 5
    assert [params.word_timestamps(a, d) for a, d in ((None, True), (None, False), (True, False), (False, False))] == [True, False, True, False]
    assert params.DecodeOptions().differs(params.DecodeOptions(beam_size=1)) == ["beam_size"]
    with pytest.raises(ValueError):
        SpeechModel(model_dir, device="tpu", spark=spark)
    with pytest.raises(ValueError):
        SpeechModel(model_dir, compute_type="int3", spark=spark)


def test_model_names(tmp_path, model_dir):
    assert registry.resolve("tiny").repo.endswith("-tiny") and registry.resolve("nemotron").subfolder and len(registry.ALIASES) == 14
    assert registry.resolve("owner/name") == registry.ModelRef(repo="owner/name") and registry.resolve(model_dir).path == model_dir
    with pytest.raises(ModelNotFound):
        registry.ensure_model("tiny", local_files_only=True)
    with pytest.raises(DownloadError):
        registry.ensure_model("tiny")
    assert registry.ensure_model("tiny", fetch=lambda repo, sub: model_dir) == model_dir
    bare = tmp_path / "bare"
    bare.mkdir()
    for missing in ("model.bin, config.json", "config.json", "tokenizer"):
        with pytest.raises(ModelNotFound, match=missing):
            registry.validate_windowed("m", str(bare))
        (bare / ("model.bin" if missing.startswith("model") else "config.json")).write_text("")
    (bare / "vocabulary.txt").write_text("")
    registry.validate_windowed("m", str(bare))
    with pytest.raises(ModelNotFound, match="encoder"):
        registry.validate_streaming("m", str(bare))
    registry.ensure_features(str(bare), "my-Large-V3")
    assert json.load(open(bare / "preprocessor_config.json"))["feature_size"] == 128
    registry.ensure_features(str(bare), "tiny")
    assert json.load(open(bare / "preprocessor_config.json"))["feature_size"] == 128
    with pytest.raises(RuntimeError, match="PATH"):
        conversion.convert_model("m", str(tmp_path / "out"))


def test_stream_equals_batch(spark, tmp_path):
    from pyspark.sql import functions as F

    luck = np.random.default_rng(5)
    rows = [(f"f{k}", i, float(p)) for k in range(4) for i, p in enumerate([*luck.choice([0.1, 0.4, 0.9], 60), 0.0, 0.0, 0.0])]
    for part in range(3):
        spark.createDataFrame([r for r in rows if r[1] // 21 == part], "file_id string, frame long, p double").coalesce(1).write.parquet(f"{tmp_path}/in/{part}")
    p = params.RegionParams(min_silence_ms=200, min_speech_ms=0, speech_pad_ms=0, frame_samples=1600)
    source = spark.readStream.schema("file_id string, frame long, p double").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    query = region_stream(source, p).writeStream.format("memory").queryName("closed").outputMode("append").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    query.awaitTermination(90)
    batch = regions.raw_regions(spark.createDataFrame(rows, "file_id string, frame long, p double").withColumn("total", F.lit(63 * 1600).cast("long")), p)
    want = sorted((r["file_id"], r["start_sample"], r["end_sample"]) for r in batch.collect())
    assert sorted(tuple(r) for r in spark.table("closed").collect()) == want and want
