"""Named queries over the stand-ins, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracklane import params
from tracklane.functions.text import chosen_language, decoder_language, is_blank, is_english, language_tag, mel_bins, shown, strip_token, target_language
from tracklane.functions.times import length, samples_of_ms, seconds, us_of_samples
from tracklane.operators import clustering, language, regions, signal, speakers, stitch, tokens, windows
from tracklane.params import RegionParams
from tracklane.plans.registry import ALIASES, resolved
from tracklane.sources import standins

FINE = RegionParams(min_silence_ms=200, frame_samples=standins.FRAME)
COARSE = RegionParams(min_silence_ms=5000, frame_samples=standins.COARSE_FRAME)


def _raw_sql(frames: str, silence: int) -> str:
    return f"""WITH {frames},
runs AS (SELECT *, sum(CASE WHEN p >= 0.5 AND NOT isnan(p) THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY frame) AS run FROM frames),
stretches AS (
  SELECT file_id, run, min(frame) AS first, min(frame) FILTER (p < 0.35) AS quiet, max(frame) FILTER (p < 0.35) AS quiet_last,
         min(total) AS total, min(step) AS step FROM runs WHERE run > 0 GROUP BY file_id, run),
closing AS (SELECT *, coalesce(least((quiet_last + 1) * step, total) - least(quiet * step, total) >= {silence}, false) AS closes FROM stretches),
islands AS (
  SELECT *, coalesce(sum(CASE WHEN closes THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY run ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS island FROM closing),
raw AS (
  SELECT file_id, min(total) AS total, least(min(first) * min(step), min(total)) AS start_sample,
         coalesce(max(CASE WHEN closes THEN least(quiet * step, total) END), min(total)) AS end_sample FROM islands GROUP BY file_id, island)"""


def _regions_sql(frames: str, silence: int) -> str:
    return _raw_sql(frames, silence) + """,
padded AS (
  SELECT file_id, greatest(start_sample - 6400, 0) AS s, least(end_sample + 6400, total) AS e FROM raw
  WHERE end_sample - start_sample >= 4000),
opened AS (
  SELECT *, CASE WHEN s > max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1
                 WHEN row_number() OVER (PARTITION BY file_id ORDER BY s, e) = 1 THEN 1 ELSE 0 END AS opens FROM padded),
grouped AS (SELECT *, sum(opens) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS region_id FROM opened),
regions AS (SELECT file_id, region_id, min(s) AS start_sample, max(e) AS end_sample FROM grouped GROUP BY file_id, region_id)"""


FINE_SQL, ROUGH_SQL = _regions_sql(standins.FRAMES_SQL, 3200), _regions_sql(standins.COARSE_SQL, 80000)
_LONGS = "CAST({0} AS BIGINT) AS {0}"


def _cast(*names: str) -> str:
    return ", ".join(_LONGS.format(n) for n in names)


def vad_raw_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.raw_regions(standins.frames(spark, sf_dir), FINE).select("file_id", "start_sample", "end_sample")


def vad_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.regions(standins.frames(spark, sf_dir), FINE)


def interval_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = regions.raw_regions(standins.frames(spark, sf_dir), FINE)
    return regions.merged(regions.padded(found, FINE)).select("file_id", "region_id", "start_sample", "end_sample")


def speech_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = standins.frames(spark, sf_dir)
    return regions.totals(frames.groupBy("file_id").agg(F.max("total").alias("total")), regions.regions(frames, FINE))


def window_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = standins.frames(spark, sf_dir, coarse=True)
    return windows.windows(regions.regions(frames, COARSE), frames, COARSE.frame_samples)


WINDOW_PLAN_SQL = "WITH RECURSIVE " + ROUGH_SQL[5:] + """,
cutting AS (
  SELECT file_id, region_id, start_sample AS pos, end_sample AS e, CAST(NULL AS BIGINT) AS slice_start FROM regions WHERE end_sample - start_sample > 480000
  UNION ALL
  SELECT c.file_id, c.region_id,
         coalesce((SELECT arg_min(f.frame, (f.p, f.frame)) * 16000 FROM frames f
                   WHERE f.file_id = c.file_id AND f.frame >= (c.pos + 448000) // 16000 AND f.frame < (c.pos + 480000) // 16000), c.pos + 480000), c.e, c.pos
  FROM cutting c WHERE c.e - c.pos > 480000),
slices AS (SELECT file_id, slice_start AS s, pos AS e FROM cutting WHERE slice_start IS NOT NULL),
tails AS (
  SELECT r.file_id, row_number() OVER (PARTITION BY r.file_id ORDER BY r.start_sample) AS i, coalesce(t.tail, r.start_sample) AS tail, r.end_sample AS e, t.tail IS NOT NULL AS long
  FROM regions r LEFT JOIN (SELECT file_id, region_id, max(pos) AS tail FROM cutting GROUP BY file_id, region_id) t USING (file_id, region_id)),
packing AS (
  SELECT file_id, i, tail AS s, e, false AS emit, CAST(NULL AS BIGINT) AS es, CAST(NULL AS BIGINT) AS ee FROM tails WHERE i = 1
  UNION ALL
  SELECT t.file_id, t.i, CASE WHEN NOT t.long AND t.e - p.s <= 480000 THEN p.s ELSE t.tail END, t.e, t.long OR t.e - p.s > 480000, p.s, p.e
  FROM packing p JOIN tails t ON t.file_id = p.file_id AND t.i = p.i + 1),
spans AS (
  SELECT file_id, s, e FROM slices UNION ALL SELECT file_id, es, ee FROM packing WHERE emit
  UNION ALL SELECT file_id, s, e FROM packing p WHERE i = (SELECT max(i) FROM tails t WHERE t.file_id = p.file_id))
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY s) - 1 AS BIGINT) AS window_id,
       CAST(s AS BIGINT) AS start_sample, CAST(e AS BIGINT) AS end_sample FROM spans"""


def window_plan_novad(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = standins.frames(spark, sf_dir, coarse=True).groupBy("file_id").agg(F.max("total").alias("total"))
    return windows.windows(regions.whole_files(files), None, 0)


def stitch_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, local = standins.local_segments(spark, sf_dir)
    out = stitch.stitched(spans, local)
    return out.select("file_id", "window_id", "seg_id", "start_us", "end_us", "text", F.when(F.col("words").isNotNull(), F.size("words")).cast("long").alias("n_words"), F.element_at("words", -1)["end_us"].alias("last_word_end_us"))


def speaker_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = standins.words(spark, sf_dir)
    found = speakers.assigned(spoken, standins.turns(spoken))
    return spoken.select("file_id", "word_id").join(found, ["file_id", "word_id"], "left")


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = standins.words(spark, sf_dir)
    return speakers.split_words(standins.segment_words(spoken), standins.turns(spoken))


def speaker_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _split(spark, sf_dir).select("file_id", "seg_id", F.col("run").cast("long").alias("run"), "speaker", "start_us", "end_us", "text", F.size("words").cast("long").alias("n_words"))


def numbered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = stitch.numbered(_split(spark, sf_dir), "seg_id", "run")
    return out.select("file_id", "id", seconds(F.col("start_us")).alias("start"), seconds(F.col("end_us")).alias("end"), "text", "speaker")


RUNS_SQL = f"""WITH {standins.WORDS_SQL}, {standins.TURNS_SQL},
met AS (
  SELECT w.file_id, w.word_id, t.speaker, sum(least(w.end_us, t.end_us) - greatest(w.start_us, t.start_us)) AS total, min(t.start_us) AS first
  FROM words w JOIN turns t ON t.file_id = w.file_id AND w.start_us < t.end_us AND t.start_us < w.end_us GROUP BY ALL),
best AS (SELECT file_id, word_id, speaker FROM met QUALIFY row_number() OVER (PARTITION BY file_id, word_id ORDER BY total DESC, first, speaker) = 1),
named AS (SELECT w.*, b.speaker FROM words w LEFT JOIN best b USING (file_id, word_id)),
changes AS (
  SELECT *, CASE WHEN lag(word_id) OVER o IS NOT NULL AND speaker IS DISTINCT FROM lag(speaker) OVER o THEN 1 ELSE 0 END AS change
  FROM named WINDOW o AS (PARTITION BY file_id, seg_id ORDER BY word_id)),
placed AS (SELECT *, sum(change) OVER (PARTITION BY file_id, seg_id ORDER BY word_id) AS run FROM changes),
joined AS (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY file_id, seg_id, run ORDER BY word_id) = 1 OR substr(word, 1, 1) IN (',', '.', '!', '?', ';', ':', '%', ')', ']', '}}', '''', '’') THEN '' ELSE ' ' END AS gap FROM placed),
whole AS (SELECT file_id, seg_id, string_agg(word, ' ' ORDER BY word_id) AS text, max(run) AS last_run FROM placed GROUP BY file_id, seg_id),
runs AS (
  SELECT file_id, seg_id, run, min(speaker) AS speaker, min(start_us) AS start_us, max(end_us) AS end_us, string_agg(gap || word, '' ORDER BY word_id) AS text, count(*) AS n_words
  FROM joined GROUP BY file_id, seg_id, run),
split_runs AS (
  SELECT r.file_id, r.seg_id, r.run, r.speaker, r.start_us, r.end_us, CASE WHEN w.last_run = 0 THEN w.text ELSE r.text END AS text, r.n_words FROM runs r JOIN whole w USING (file_id, seg_id))"""


def silent_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as segments, without words (null or none) or without speakers: all pass through whole."""
    rows = standins.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id"), F.col("turn").cast("long").alias("seg_id"), "turn", F.coalesce("text", F.lit("")).alias("text"))
    word = F.expr("named_struct('start_us', 5L, 'end_us', 9L, 'word', text, 'probability', 1.0D)")
    listed = F.when(F.col("turn") % 3 == 1, F.array(word)).when(F.col("turn") % 3 == 2, F.slice(F.array(word), 1, 0))
    out = speakers.split_segments(rows.select("file_id", "seg_id", F.lit(0).cast("long").alias("start_us"), F.lit(10).cast("long").alias("end_us"), "text", listed.alias("words")), None)
    return out.select("file_id", "seg_id", F.col("run").cast("long").alias("run"), "speaker", "start_us", "end_us", "text", F.when(F.col("words").isNotNull(), F.size("words")).cast("long").alias("n_words"))


def token_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_segments(standins.tokens(standins.words(spark, sf_dir)))
    return out.select("file_id", "window_id", "seg_id", "start_us", "end_us", "text", F.size("words").cast("long").alias("n_words"), F.element_at("words", 1)["probability"].alias("probability"))


def tagged_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two documents are a file; a third of them emit a tag, a third something like one."""
    docs = standins.table(spark, sf_dir, "documents")
    kind = F.col("doc_id") % 3
    piece = F.when(kind == 0, F.concat(F.lit("<"), F.col("lang"), F.lit(">"))).when(kind == 1, F.concat(F.lit("<|"), F.col("lang"), F.lit("|>"))).otherwise(F.col("lang"))
    rows = docs.select(F.floor(F.col("doc_id") / 2).alias("file_id"), (-F.col("doc_id")).alias("pos"), piece.alias("piece"), (-(F.col("doc_id") % 5) / 4).alias("logprob"))
    return language.tagged_language(rows).select("file_id", "language", F.round("probability", 6).alias("probability"))


def language_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is asked for, what is set on a model of many languages and on an English one, which refuses others."""
    docs = standins.table(spark, sf_dir, "documents")
    explicit = F.when(F.col("doc_id") % 4 == 0, F.col("lang"))
    configured = F.when(F.col("doc_id") % 3 == 0, F.lit("auto")).when(F.col("doc_id") % 3 == 1, F.lit("EN-gb"))
    rows = docs.select("doc_id", chosen_language(explicit, configured).alias("chosen"))
    fits = F.coalesce((F.col("chosen") == "auto") | is_english(F.col("chosen")), F.lit(False))
    return rows.select("doc_id", "chosen", target_language(F.col("chosen"), F.lit(False)).alias("many"), target_language(F.col("chosen"), fits).alias("one"), fits.alias("fits"))


BLANKS = ("", " ", "\t", "\u0085", "\u00a0", "\u2003", "\u2028", "\u3000", "\u200b", ".")


def blank_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = standins.table(spark, sf_dir, "documents").select("lang").distinct()
    texts = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(b).alias("b")) for i, b in enumerate(BLANKS)]))
    rows = codes.select("lang", texts.alias("x")).select("lang", F.col("x.i").alias("i"), F.col("x.b").alias("b"))
    return rows.select("lang", "i", is_blank(F.concat("b", F.lit(" "), "b")).alias("alone"), is_blank(F.concat("b", "lang", "b")).alias("around"))


def time_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms, sample = F.col("event_id").cast("long") * 7, F.col("event_id").cast("long") * 3
    back = F.col("event_id") % 2 == 0
    return standins.table(spark, sf_dir, "events").select(
        "event_id", samples_of_ms(ms).alias("samples"), us_of_samples(sample).alias("us"),
        length(F.when(back, ms).otherwise(sample), F.when(back, sample).otherwise(ms)).alias("duration"), seconds(us_of_samples(sample)).alias("seconds"),
        shown("Segment", F.floor(us_of_samples(sample) / 10_000) / 100, F.floor(us_of_samples(sample) / 10_000) / 100 + 0.5, F.lit("x")).alias("shown"),
    )


def speaker_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    spoken = standins.words(spark, sf_dir)
    return speakers.speaker_counts(standins.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("file_id")).distinct(), standins.turns(spoken))


def lang_first_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = standins.table(spark, sf_dir, "documents").select(F.col("source").alias("file_id"), F.col("doc_id").alias("window_id"), F.col("lang").alias("language"), F.lit(1.0).alias("probability"))
    return language.file_language(docs.select("file_id").distinct(), docs)


TOKENS = ("<|{}|>", "<{}>", "<{}-XX>", "{}", "<|{}|", "<{}|>")


def lang_tag_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = standins.table(spark, sf_dir, "documents").select("lang").distinct()
    token = F.explode(F.array(*[F.concat(F.lit(t.split("{}")[0]), F.col("lang"), F.lit(t.split("{}")[1])) for t in TOKENS])).alias("token")
    rows = codes.select("lang", token)
    tag = language_tag(F.col("token"))
    return rows.select("lang", "token", strip_token(F.col("token")).alias("stripped"), tag.alias("tag"), F.coalesce(is_english(tag), F.lit(False)).alias("english"), decoder_language(F.coalesce(tag, F.lit("unknown"))).alias("decoder"))


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return standins.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("file_id"), F.col("embedding").alias("samples"), "label")


def frame_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal.magnitude_scores(signal.framed(_samples(spark, sf_dir), 24))


def pcm_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select("file_id", F.posexplode("samples").alias("pos", "x"))
    return rows.select("file_id", F.col("pos").cast("long").alias("pos"), signal.quantized(F.col("x")).cast("long").alias("sample"))


def dense_relabel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select((F.col("file_id") % 7).alias("file_id"), F.col("file_id").alias("pos"), "label")
    return clustering.dense_labels(rows).select("file_id", "pos", F.col("label").cast("long").alias("label"), "dense")


def model_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*ALIASES, "owner/name", "unheard-of"]
    rows = spark.sql("SELECT explode(array(" + ", ".join(f"'{n}'" for n in names) + ")) AS name")
    return rows.select("name", resolved(F.col("name")).alias("found"), mel_bins(F.col("name")).cast("long").alias("mel_bins")).select("name", "found.repo", "found.subfolder", "mel_bins")


def _registry_sql() -> str:
    rows = ", ".join(f"('{n}', '{r}', {'NULL' if s is None else repr(s)}, {128 if 'large-v3' in n else 80})" for n, (r, s) in [*ALIASES.items(), ("owner/name", ("owner/name", None)), ("unheard-of", ("unheard-of", None))])
    return f"SELECT name, repo, subfolder, CAST(mel_bins AS BIGINT) AS mel_bins FROM (VALUES {rows}) t(name, repo, subfolder, mel_bins)"


def kmeans_exact_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select((F.col("file_id") % 5).alias("file_id"), F.col("file_id").alias("pos"), F.col("samples").alias("vector"))
    return clustering.clustered(rows, 4)


def clusters_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _samples(spark, sf_dir).select((F.col("file_id") % 5).alias("file_id"), F.col("file_id").alias("pos"), F.col("samples").alias("vector"))
    return clustering.clustered(rows, None, most=params.DEFAULT_MAX_SPEAKERS)


def mel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    tiled = _samples(spark, sf_dir).select("file_id", F.flatten(F.array_repeat("samples", 25)).alias("samples"))
    made = signal.mel_features(tiled, 80, 16)
    return made.select("file_id", F.size("features").cast("long").alias("n_features"), F.size(F.filter("features", lambda x: x != 0)).cast("long").alias("n_filled"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        vad_regions, vad_raw_regions, interval_merge, speech_totals, window_plan, window_plan_novad, stitch_segments, speaker_assign, speaker_runs, numbered_segments,
        speaker_counts, lang_first_window, lang_tag_parse, frame_peaks, pcm_quantize, dense_relabel, model_registry, kmeans_exact_k, mel_frames,
        silent_segments, token_segments, tagged_language, language_choice, blank_texts, time_functions, clusters_apart,
    )
}

ORACLE_SQL: dict[str, str] = {
    "vad_raw_regions": f"{_raw_sql(standins.FRAMES_SQL, 3200)} SELECT {_cast('file_id', 'start_sample', 'end_sample')} FROM raw",
    "vad_regions": f"{FINE_SQL} SELECT {_cast('file_id', 'region_id', 'start_sample', 'end_sample')} FROM regions",
    "interval_merge": f"{FINE_SQL.replace('WHERE end_sample - start_sample >= 4000', '')} SELECT {_cast('file_id', 'region_id', 'start_sample', 'end_sample')} FROM regions",
    "speech_totals": f"""{FINE_SQL}, files AS (SELECT file_id, max(total) AS total FROM frames GROUP BY file_id),
spoken AS (SELECT file_id, sum(end_sample - start_sample) AS speech FROM regions GROUP BY file_id)
SELECT CAST(file_id AS BIGINT) AS file_id, total / 16000.0::DOUBLE AS duration, coalesce(speech, 0)::DOUBLE / 16000.0::DOUBLE AS duration_after_vad FROM files LEFT JOIN spoken USING (file_id)""",
    "window_plan": WINDOW_PLAN_SQL,
    "window_plan_novad": f"""WITH {standins.COARSE_SQL}, files AS (SELECT file_id, max(total) AS total FROM frames GROUP BY file_id),
starts AS (SELECT file_id, total, unnest(generate_series(0, (total - 1) // 480000)) AS k FROM files WHERE total > 0)
SELECT CAST(file_id AS BIGINT) AS file_id, CAST(k AS BIGINT) AS window_id, CAST(k * 480000 AS BIGINT) AS start_sample, CAST(least((k + 1) * 480000, total) AS BIGINT) AS end_sample FROM starts""",
    "stitch_segments": """WITH rows AS (SELECT conv_id AS file_id, turn AS window_id, list_filter(string_split(text, ' '), lambda x: x <> '') AS ws FROM conversations),
made AS (SELECT *, len(ws) AS n, unnest(generate_series(0, (len(ws) - 1) // 10)) AS k FROM rows WHERE len(ws) > 0),
parts AS (SELECT file_id, window_id, k, least(n * 200000, 30000000) AS real_us, window_id * 30000000 AS offset_us, ws[k * 10 + 1 : least(k * 10 + 10, n)] AS part FROM made),
kept AS (SELECT *, least(len(part), greatest(0, (real_us + 299999) // 300000 - k * 10)) AS words FROM parts WHERE k * 3000000 < real_us)
SELECT file_id, window_id, CAST(k AS BIGINT) AS seg_id, CAST(offset_us + k * 3000000 AS BIGINT) AS start_us,
       CAST(offset_us + least((k * 10 + len(part) - 1) * 300000 + 250000, real_us) AS BIGINT) AS end_us, array_to_string(part, ' ') AS text,
       CAST(CASE WHEN words > 0 THEN words END AS BIGINT) AS n_words,
       CAST(CASE WHEN words > 0 THEN offset_us + least((k * 10 + words - 1) * 300000 + 250000, real_us) END AS BIGINT) AS last_word_end_us FROM kept""",
    "speaker_assign": f"{RUNS_SQL} SELECT {_cast('file_id', 'word_id', 'speaker')} FROM named",
    "speaker_runs": f"{RUNS_SQL} SELECT {_cast('file_id', 'seg_id', 'run', 'speaker', 'start_us', 'end_us')}, text, {_cast('n_words')} FROM split_runs",
    "numbered_segments": f"""{RUNS_SQL} SELECT {_cast('file_id')}, CAST(row_number() OVER (PARTITION BY file_id ORDER BY seg_id, run) - 1 AS BIGINT) AS id,
round(start_us / 1000000.0::DOUBLE, 6) AS start, round(end_us / 1000000.0::DOUBLE, 6) AS "end", text, {_cast('speaker')} FROM split_runs""",
    "speaker_counts": f"WITH {standins.WORDS_SQL}, {standins.TURNS_SQL} SELECT CAST(c.file_id AS BIGINT) AS file_id, CAST(count(DISTINCT t.speaker) AS BIGINT) AS num_speakers FROM (SELECT DISTINCT conv_id AS file_id FROM conversations) c LEFT JOIN turns t USING (file_id) GROUP BY c.file_id",
    "lang_first_window": "SELECT source AS file_id, arg_min(lang, doc_id) AS language, 1.0::DOUBLE AS language_probability FROM documents GROUP BY source",
    "lang_tag_parse": """WITH tokens AS (SELECT DISTINCT lang, unnest(['<|' || lang || '|>', '<' || lang || '>', '<' || lang || '-XX>', lang, '<|' || lang || '|', '<' || lang || '|>']) AS token FROM documents),
tagged AS (SELECT *, CASE WHEN regexp_full_match(token, '<[a-z]{2}(-[A-Z]{2})?>') THEN token[2:-2] END AS tag FROM tokens)
SELECT lang, token, CASE WHEN starts_with(token, '<|') AND ends_with(token, '|>') AND length(token) >= 4 THEN token[3:-3] ELSE token END AS stripped, tag,
coalesce(lower(regexp_split_to_array(tag, '[-_]')[1]) = 'en', false) AS english, coalesce(tag, 'auto') AS decoder FROM tagged""",
    "frame_peaks": """WITH parts AS (SELECT vec_id, embedding, unnest(generate_series(0, (len(embedding) - 1) // 24)) AS frame FROM embeddings WHERE len(embedding) > 0)
SELECT vec_id AS file_id, CAST(frame AS BIGINT) AS frame,
CASE WHEN list_max(list_transform(embedding[frame * 24 + 1 : least(frame * 24 + 24, len(embedding))], lambda x: abs(x::DOUBLE))) > 0.1::DOUBLE THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS p FROM parts""",
    "pcm_quantize": """WITH x AS (SELECT vec_id, unnest(embedding) AS v, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings)
SELECT vec_id AS file_id, CAST(pos AS BIGINT) AS pos, CAST(trunc(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, v::DOUBLE)) * 32767) AS BIGINT) AS sample FROM x""",
    "dense_relabel": """WITH firsts AS (SELECT vec_id % 7 AS file_id, label, min(vec_id) AS first FROM embeddings GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY first) - 1 AS dense FROM firsts)
SELECT e.vec_id % 7 AS file_id, e.vec_id AS pos, CAST(e.label AS BIGINT) AS label, CAST(r.dense AS BIGINT) AS dense FROM embeddings e JOIN ranked r ON r.file_id = e.vec_id % 7 AND r.label = e.label""",
    "model_registry": _registry_sql(),
    "silent_segments": """SELECT conv_id AS file_id, CAST(turn AS BIGINT) AS seg_id, CAST(0 AS BIGINT) AS run, CAST(NULL AS BIGINT) AS speaker, CAST(0 AS BIGINT) AS start_us, CAST(10 AS BIGINT) AS end_us,
coalesce(text, '') AS text, CAST(CASE turn % 3 WHEN 1 THEN 1 WHEN 2 THEN 0 END AS BIGINT) AS n_words FROM conversations""",
    "token_segments": f"""WITH {standins.WORDS_SQL}, tokens AS (SELECT file_id, turn, word_id, start_us + word_id % 3 * 400000 AS s, end_us + word_id % 3 * 400000 AS e, word FROM words)
SELECT file_id, CAST(turn AS BIGINT) AS window_id, CAST(0 AS BIGINT) AS seg_id, CAST(arg_min(s, word_id) AS BIGINT) AS start_us, CAST(arg_max(e, word_id) AS BIGINT) AS end_us,
string_agg(word, ' ' ORDER BY word_id) AS text, count(*) AS n_words, 1.0::DOUBLE AS probability FROM tokens GROUP BY file_id, turn""",
    "tagged_language": """WITH tags AS (SELECT CAST(doc_id // 2 AS BIGINT) AS file_id, doc_id, CASE WHEN doc_id % 3 = 0 THEN lang END AS tag FROM documents)
SELECT file_id, coalesce(arg_max(tag, doc_id) FILTER (tag IS NOT NULL), 'unknown') AS language,
coalesce(round(exp(arg_max(-(doc_id % 5) / 4.0::DOUBLE, doc_id) FILTER (tag IS NOT NULL)), 6), 0.0::DOUBLE) AS probability FROM tags GROUP BY file_id""",
    "language_choice": """WITH asked AS (SELECT doc_id, coalesce(CASE WHEN doc_id % 4 = 0 THEN lang END, CASE doc_id % 3 WHEN 0 THEN 'auto' WHEN 1 THEN 'EN-gb' END) AS chosen FROM documents),
judged AS (SELECT *, coalesce(chosen IN ('auto', 'en', 'EN-gb'), false) AS fits FROM asked)
SELECT doc_id, chosen, chosen AS many, CASE WHEN fits THEN NULL ELSE chosen END AS one, fits FROM judged""",
    "blank_texts": """WITH codes AS (SELECT DISTINCT lang FROM documents)
SELECT lang, CAST(i AS BIGINT) AS i, i < 8 AS alone, false AS around FROM codes, range(10) t(i)""",
    "time_functions": """WITH e AS (SELECT event_id, CAST(event_id AS BIGINT) * 7 AS ms, CAST(event_id AS BIGINT) * 3 AS s, CAST(event_id AS BIGINT) * 3 * 1000 // 16 AS us FROM events)
SELECT event_id, ms * 16 AS samples, us, CASE WHEN event_id % 2 = 0 THEN 0 ELSE ms - s END AS duration, round(us / 1000000.0::DOUBLE, 6) AS seconds,
printf('Segment(start=%.2f, end=%.2f, text=''x'')', us // 10000 / 100.0::DOUBLE, us // 10000 / 100.0::DOUBLE + 0.5::DOUBLE) AS shown FROM e""",
}
