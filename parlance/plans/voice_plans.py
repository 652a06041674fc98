"""Voice-corpus queries over bursts and frames made from events, and over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from parlance.operators import voice as O
from parlance.plans import views as V
from parlance.sources.files import write_dataset
from parlance.sources.tables import scratch

QUERIES: dict = {}
ORACLES: dict = {}


def add(name: str, fn, sql: str | None = None) -> None:
    QUERIES[name] = fn
    if sql:
        ORACLES[name] = sql


spans = V.spans


def _joined(rows: str, keys: str, fits: str, out: str) -> str:
    """CTEs that number the rows (keys, rn, s, e) of a table alike while `fits` holds of n.s, n.e, the first start and the end so far; `out` has the joined ones."""
    same = " and ".join(f"n.{k} = r.{k}" for k in keys.split(", "))
    nk = ", ".join(f"n.{k}" for k in keys.split(", "))
    return f"""{out}_r as (select {keys}, rn, s, e, s as first, 0::bigint as i from {rows} where rn = 1
  union all select {nk}, n.rn, n.s, n.e, case when {fits} then r.first else n.s end, r.i + case when {fits} then 0 else 1 end from {out}_r r
  join {rows} n on {same} and n.rn = r.rn + 1),
{out} as (select {keys}, i, min(s) as s, arg_max(e, rn) as e, min(rn) as rn0 from {out}_r group by {keys}, i)"""


S = f"with {V.SPANS}"


def frames(s, d):
    """Energy and pitch of frames: a user is a clip, an event a frame."""
    e = V.table(s, d, "events")
    return e.select(F.col("user_id").alias("clip"), F.col("event_id").alias("frame"), (F.col("event_id") * 97 % 1000 / 1000.0).alias("rms"), (50.0 + F.col("event_id") * 31 % 400).alias("f0"))


FRAMES = "frames as (select user_id as clip, event_id as frame, event_id * 97 % 1000 / 1000.0::double as rms, 50.0::double + event_id * 31 % 400 as f0 from events)"


def segments(s, d):
    """Timed segments of characters: some from subtitles, some from voice search, a few without text."""
    return spans(s, d).select(
        F.concat(F.lit("c"), (F.col("clip") % 10).cast("string")).alias("character"), F.col("clip").alias("episode"), "s_ms", "e_ms",
        F.when(F.col("seq") % 9 == 0, "").otherwise(F.concat(F.lit("line "), F.col("seq").cast("string"))).alias("text"), (F.col("seq") % 50 / 50.0).alias("score"),
        F.when(F.col("seq") % 4 == 0, "sdh").otherwise("voice").alias("source"),
    )


SEGMENTS = V.SPANS + """, segments as (select 'c' || clip % 10 as character, clip as episode, s_ms, e_ms, case
  when seq % 9 = 0 then '' else 'line ' || seq end as text, seq % 50 / 50.0::double as score,
  case when seq % 4 = 0 then 'sdh' else 'voice' end as source from spans)"""
RANK = "order by case when source = 'sdh' then 0 else 1 end, score desc, e_ms - s_ms desc, s_ms"
unique = lambda seg: seg.groupBy("character", "s_ms", "e_ms", "source", "score").agg(F.min("text").alias("text"), F.min("episode").alias("episode"))
UNIQUE = SEGMENTS + ", u as (select character, s_ms, e_ms, source, score, min(text) as text, min(episode) as episode from segments group by all)"

add(
    "ivl_utt", lambda s, d: O.utterances(spans(s, d)),
    f"""with recursive {V.SPANS}, b as (select clip, seq as rn, s_ms as s, e_ms as e from spans), {_joined('b', 'clip', 'n.e - r.first <= 14000 and n.s - r.e <= 600', 'u')},
v as (select clip, row_number() over (partition by clip order by i) as rn, s, e from u), {_joined('v', 'clip', 'n.e - n.s < 1000 and n.e - r.first <= 14000', 'm')}
select clip, greatest(0, s - 150) as s_ms, e + 250 as e_ms from m where e - s >= 1000""",
)
ISLES = V.SPANS + """, f as (select *, case when s_ms <= max(e_ms) over (partition by clip order by s_ms, e_ms rows between unbounded preceding
  and 1 preceding) then 0 else 1 end as new from spans),
g as (select *, sum(new) over (partition by clip order by s_ms, e_ms) as i from f), isles as (select clip, min(s_ms) as s_ms, max(e_ms) as e_ms from g group by clip, i)"""
add("ivl_overlap_fix", lambda s, d: O.fix_overlaps(spans(s, d)), f"with {ISLES} select * from isles")
PROFILE = ISLES + ", p as (select clip, cast(sum(e_ms - s_ms) as bigint) as speech_ms, cast(max(e_ms) - min(s_ms) - sum(e_ms - s_ms) as bigint) as gap_ms, count(*) as bursts from isles group by 1)"
add("agg_pause", lambda s, d: O.pause_profile(spans(s, d)), f"with {PROFILE} select * from p")
add(
    "agg_rhythm", lambda s, d: O.rhythm(O.pause_profile(spans(s, d))),
    f"with {PROFILE} select clip, case when speech_ms >= 2000 then round(gap_ms / speech_ms, 6) end as pause_ratio, case when speech_ms >= 2000 then round(bursts * 1000 / speech_ms, 6) end as burst_rate, case when speech_ms >= 2000 then round(speech_ms / 1000 / bursts, 6) end as burst_sec from p",
)


def _paced(s, d):
    p = O.pause_profile(spans(s, d)).withColumn("words", F.floor(F.col("speech_ms") / 400))
    return p.withColumn("voice", F.col("clip") % 10)


add(
    "agg_pace", lambda s, d: O.pace_plan(_paced(s, d), _paced(s, d).where("clip % 10 = 3")),
    f"""with {PROFILE}, q as (select *, speech_ms // 400 as words, clip % 10 as voice from p), st as (select sum(words) * 1000 / sum(speech_ms) as a,
  sum(gap_ms) / sum(speech_ms) as g from q where clip % 10 = 3),
v as (select voice, sum(words) * 1000 / sum(speech_ms) as a, sum(gap_ms) / sum(speech_ms) as g from q group by 1),
r as (select voice, round(greatest(0.87, least(1.15, st.a / v.a)), 6) as rate, round(st.g / greatest(v.g, 0.02) * 1.6, 6) as pause_scale from v, st)
select voice, rate::double as rate, pause_scale::double as pause_scale, abs(rate - 1) < 0.03 and abs(pause_scale - 1) < 0.15 as little_change from r""",
)
add(
    "ivl_retime", lambda s, d: O.retime_plan(spans(s, d), 0.9, 1.4),
    f"""{S}, l as (select *, lead(s_ms) over (partition by clip order by seq) - e_ms as gap, e_ms - s_ms as dur from spans),
w as (select *, least(1500.0::double, gap * 1.4::double) as want from l)
select clip, round(sum(case when dur > 250 then dur / 0.9::double else dur end + coalesce(case when abs(want - gap) <= 10 then gap
  when want < gap then greatest(want, 40.0) else want end, 0)), 3) as new_ms,
  round(sum(case when dur > 250 then dur / 0.9::double else dur end + coalesce(case when abs(want - gap) <= 10 then gap when want < gap then greatest(want,
  40.0) else want end, 0)), 3) <= 14500 as kept from w group by 1""",
)
add(
    "ivl_tv_merge", lambda s, d: O.merge_segments(segments(s, d)),
    f"""with recursive {SEGMENTS}, n0 as (select *, row_number() over (partition by character, episode order by s_ms, e_ms, text) as rn from segments),
  b as (select character, episode, rn, s_ms as s, e_ms as e from n0),
{_joined('b', 'character, episode', 'n.s - r.e between 0 and 600 and n.e - r.first <= 14000', 'u')}
select r.character, r.episode, min(n0.s_ms) as s_ms, arg_max(n0.e_ms, n0.rn) as e_ms, case
  when count(*) = 1 then min(n0.text) else ltrim(coalesce(string_agg(rtrim(n0.text), ' ' order by n0.rn) filter (where rtrim(n0.text) <> ''), '')) end as text,
  min(n0.score) as score, case when bool_and(n0.source = 'sdh') then 'sdh' else 'voice' end as source from u_r r join n0 using (character, episode, rn)
  group by r.character, r.episode, r.i""",
)
add(
    "ivl_train_pick", lambda s, d: O.training_segments(unique(segments(s, d))).select("character", "s_ms", "e_ms", "rank"),
    f"with {UNIQUE} select character, s_ms, e_ms, row_number() over (partition by character {RANK}) as rank from u where e_ms - s_ms between 1000 and 14000 and text <> ''",
)
add("top_rank_seg", lambda s, d: O.rank_segments(unique(segments(s, d))).select("character", "s_ms", "e_ms", "source", "rank"), f"with {UNIQUE} select character, s_ms, e_ms, source, row_number() over (partition by character {RANK}) as rank from u")
add(
    "win_ref_pick", lambda s, d: O.pick_reference(unique(segments(s, d)), 45_000).select("character", "s_ms", "e_ms", "before_ms"),
    f"with {UNIQUE}, r as (select *, coalesce(sum(e_ms - s_ms + 100) over (partition by character {RANK} rows between unbounded preceding and 1 preceding), 0) as before_ms from u where e_ms - s_ms >= 600) select character, s_ms, e_ms, cast(before_ms as bigint) as before_ms from r where before_ms < 45000",
)
add("top_longest", lambda s, d: O.longest(spans(s, d), 3), f"{S}, r as (select *, row_number() over (partition by clip order by dur_ms desc, seq) as r from spans) select clip, seq, dur_ms from r where r <= 3")


add(
    "win_ref_concat", lambda s, d: O.reference_plan(spans(s, d)),
    f"{S}, r as (select *, coalesce(sum(dur_ms) over (partition by clip order by dur_ms desc, seq rows between unbounded preceding and 1 preceding), 0)::bigint as before_ms from spans) select clip, seq, before_ms, least(dur_ms, 60000 - before_ms) as take_ms from r where before_ms < 45000",
)


_named = lambda s, d: spans(s, d).withColumns({"name": F.concat(F.lit("u"), (F.col("seq") * 7 % 100).cast("string")), "rate": F.when(F.col("seq") % 5 > 0, F.when(F.col("seq") % 3 == 0, 16_000).otherwise(24_000))})
add(
    "win_ref_names", lambda s, d: O.reference_plan(_named(s, d), 45_000, 45_000, "name"),
    f"""{S}, x as (select *, 'u' || seq * 7 % 100 as name, case when seq % 5 > 0 then case when seq % 3 = 0 then 16000 else 24000 end end as rate from spans),
y as (select x.* from x join (select clip, arg_min(rate, (name, seq)) as first from x where rate is not null group by 1) f on f.clip = x.clip and f.first = x.rate),
r as (select *, coalesce(sum(dur_ms) over (partition by clip order by name, seq rows between unbounded preceding and 1 preceding), 0)::bigint as before_ms from y)
select clip, seq, before_ms, least(dur_ms, 45000 - before_ms) as take_ms from r where before_ms < 45000""",
)
add("ivl_clip_spans", lambda s, d: O.concat_spans(spans(s, d)), f"{S}, r as (select clip, seq, dur_ms, coalesce(sum(dur_ms + 100) over (partition by clip order by seq rows between unbounded preceding and 1 preceding), 0)::bigint as s_ms from spans) select clip, seq, s_ms, s_ms + dur_ms as e_ms from r")
add(
    "ivl_gender", lambda s, d: O.gender_filter(spans(s, d).withColumn("f0", 50.0 + F.col("seq") * 37 % 400 + F.col("clip") % 3 * 400), 160.0, 330.0).select("clip", "seq", "f0"),
    f"{S}, f as (select clip, seq, 50.0::double + seq * 37 % 400 + clip % 3 * 400 as f0 from spans), g as (select *, bool_or(f0 between 160 and 330) over (partition by clip) as any_in from f) select clip, seq, f0 from g where f0 between 160 and 330 or not any_in",
)


def _dataset(s, d):
    rows = segments(s, d).select(F.col("character").alias("voice"), (F.col("episode") * 10**7 + F.col("s_ms")).alias("seq"), "s_ms", "e_ms", "text", (F.col("s_ms") % 11 / 10.0).alias("peak"))
    return O.dataset_rows(rows, block=10**7)


_D = f"""with {SEGMENTS}, d as (select character as voice, character || '_' || printf('%04d', row_number() over (partition by character order by episode,
  s_ms)) as utt_id, text, e_ms - s_ms as dur_ms
  from segments where text <> '' and e_ms - s_ms between 1000 and 14500 and s_ms % 11 <> 0)"""
add("ivl_dataset", _dataset, f"{_D} select * from d")
add("snk_utt_id", lambda s, d: _dataset(s, d).select("voice", "utt_id"), f"{_D} select voice, utt_id from d")


def _metadata(s, d):
    path = scratch(s, "dataset")
    write_dataset(_dataset(s, d), path)
    return s.read.text(path).select("voice", F.col("value").alias("row"))


add("snk_metadata", _metadata, f"{_D} select voice, utt_id || '|' || text || '|' || text as row from d")
add(
    "agg_dataset", lambda s, d: O.dataset_summary(_dataset(s, d)),
    f"{_D} select voice, count(*) as n, round(sum(dur_ms) / 60000, 4)::double as minutes, sum(dur_ms) < 60000 as thin from d group by 1",
)
_LEVEL = f"with {FRAMES}, m as (select clip, max(rms) as m, count(*) as n from frames group by 1), lv as (select f.clip, case when any_value(n) >= 3 then round(20 * log10(avg(case when rms > 0 and rms > m * 0.01 then rms end) + 1e-12), 4) end as dbfs from frames f join m using (clip) group by 1)"
add("agg_loudness", lambda s, d: O.speech_level(frames(s, d)), f"{_LEVEL} select * from lv")
add(
    "agg_voice_level", lambda s, d: O.voice_level(O.speech_level(frames(s, d)).withColumn("voice", F.col("clip") % 70).withColumn("is_reference", F.col("clip") % 140 == 3)),
    f"""{_LEVEL}, r as (select clip % 70 as voice, dbfs, row_number() over (partition by clip % 70 order by clip) as r from lv where clip % 140 <> 3),
a as (select clip % 70 as voice, arg_min(dbfs, clip) as alone from lv where clip % 140 = 3 group by 1), mean as (select voice, avg(dbfs) as mean from r where r <= 10 group by 1)
select voice, round(coalesce(alone, mean), 6) as dbfs from mean full join a using (voice)""",
)
add(
    "agg_pitch", lambda s, d: O.pitch_stats(frames(s, d)),
    f"with {FRAMES}, m as (select clip, max(rms) as m from frames group by 1), v as (select clip, f0, 12 * log2(f0 / 55.0) as st from frames join m using (clip) where rms > 0.1 * m and f0 > 60 and f0 < 400) select clip, case when count(*) >= 10 then round(quantile_cont(f0, 0.5), 4) end as f0_med, case when count(*) >= 10 then round(quantile_cont(st, 0.75) - quantile_cont(st, 0.25), 4) end as f0_iqr from v group by 1",
)
_G = "power(10.0::double, greatest(-12.0, least(12.0, -20.0 - dbfs)) / 20)"
add(
    "gain_plan", lambda s, d: O.speech_level(frames(s, d)).select("clip", F.round(O.gain_db(F.col("dbfs"), -20.0, F.lit(0.6)), 5).alias("gain")),
    f"{_LEVEL} select clip, case when dbfs is null then null when 0.6 * {_G} > 0.985 then round(0.985 / 0.6, 5)::double else round({_G}, 5) end as gain from lv",
)
levels = lambda s, d: spans(s, d).select("clip", "seq", F.when(F.col("seq") % 7 != 0, -30.0 + F.col("dur_ms") % 1500 / 100.0).alias("dbfs"))
#: Smoothed gains r(clip, rn, seq, g) of levels l(clip, rn, seq, dbfs), for a `with recursive`.
GAINS = """r(clip, rn, seq, g) as (
  select distinct clip, 0::bigint, null::bigint, null::double from l union all
  select l.clip, l.rn, l.seq, case when l.dbfs is null then r.g when r.g is null then power(10.0::double, greatest(-12.0, least(12.0, -20.0 - l.dbfs)) / 20)
    else 0.7 * r.g + 0.3 * power(10.0::double, greatest(-12.0, least(12.0, -20.0 - l.dbfs)) / 20) end from r join l on l.clip = r.clip and l.rn = r.rn + 1)"""
add(
    "win_gain_ema", lambda s, d: O.smooth_gain(levels(s, d), -20.0),
    f"""with recursive {V.SPANS}, l as (select clip, seq, seq as rn, case when seq % 7 <> 0 then -30.0::double + dur_ms % 1500 / 100.0::double end as dbfs from spans), {GAINS}
select clip, seq, round(g, 5) as gain from r where rn > 0""",
)


def samples(s, d):
    return V.table(s, d, "embeddings").select(F.col("vec_id").alias("clip"), F.posexplode("embedding").alias("i", "v"))


SAMPLES = "samples as (select vec_id as clip, unnest(range(64)) as i, unnest(embedding)::double as v from embeddings)"
add(
    "agg_trace", lambda s, d: O.wave_trace(samples(s, d), 7).select("clip", "step", F.round(F.col("low").cast("double"), 5).alias("low"), F.round(F.col("high").cast("double"), 5).alias("high")),
    f"with {SAMPLES} select clip, i // 9 as step, round(min(v), 5) as low, round(max(v), 5) as high from samples where i // 9 < 7 group by 1, 2",
)
add("agg_decimate", lambda s, d: O.decimate(samples(s, d).withColumn("v", F.col("v").cast("double"))), f"with {SAMPLES} select clip, i // 6 as i, round(avg(v), 6) as v from samples group by 1, 2 having count(*) = 6")
add(
    "xfade", lambda s, d: O.crossfade(samples(s, d).select((F.floor(F.col("clip") / 4)).alias("clip"), (F.col("clip") % 4).alias("chunk"), "i", F.lit(64).alias("n"), (F.col("clip") % 4 == 3).alias("last"), F.col("v").cast("double").alias("v")), 16),
    f"with {SAMPLES}, c as (select clip // 4 as clip, clip % 4 as chunk, i, v from samples) select clip, chunk * 48 + i as at, round(sum(v * case when chunk > 0 and i < 16 then i / 16.0::double else 1 end * case when chunk <> 3 and i >= 48 then (64 - i) / 16.0::double else 1 end), 5) as v from c group by 1, 2",
)
_MEAN = "d as (select {k}, i, avg(v) as x from (select {k}, unnest(range(64)) as i, unnest(embedding)::double as v from {t}) group by 1, 2), n as (select {k}, sqrt(sum(x * x)) as n from d group by 1), cen as (select {k}, list(round(x / n, 5) order by i) as embedding from d join n using ({k}) group by 1)"
vectors = lambda s, d: V.table(s, d, "embeddings")
add("agg_centroid", lambda s, d: O.centroids(vectors(s, d), "label"), f"with {_MEAN.format(k='label', t='embeddings')} select * from cen")
add("agg_partial_mean", lambda s, d: O.centroids(vectors(s, d).withColumn("utt", F.floor(F.col("vec_id") / 5)), "utt"), f"with {_MEAN.format(k='utt', t='(select *, vec_id // 5 as utt from embeddings)')} select * from cen")
add(
    "agg_statpool", lambda s, d: O.stat_pool(vectors(s, d).withColumn("part", F.floor(F.col("vec_id") / 100)), ["label", "part"]),
    "select label, part, d, round(avg(x), 5) as mean, round(stddev_samp(x), 5) as std from (select label, vec_id // 100 as part, unnest(range(64)) as d, unnest(embedding)::double as x from embeddings) group by 1, 2, 3",
)
add("agg_dominant", lambda s, d: O.dominant_cluster(vectors(s, d).withColumn("who", F.floor(F.col("vec_id") / 50)), "who"))


QUERIES["sim_cosine"] = lambda s, d: vectors(s, d).join(O.centroids(vectors(s, d), "label").withColumnRenamed("embedding", "c"), "label").select("vec_id", "label", F.round(O.cosine(F.col("embedding"), F.col("c")), 4).alias("cos"))
ORACLES["sim_cosine"] = f"with {_MEAN.format(k='label', t='embeddings')} select vec_id, label, round(list_cosine_similarity(e.embedding::double[], c.embedding), 4) as cos from embeddings e join cen c using (label)"


def _features(s, d):
    e = vectors(s, d)
    side = lambda p: (F.col("embedding").cast("array<double>").alias(f"{p}_embed"), F.slice("embedding", 1, 8).cast("array<double>").alias(f"{p}_ltas"), F.when(F.col("vec_id") % 5 != 0, 100.0 + F.col("vec_id") % 60).alias(f"{p}_f0_med"), (2.0 + F.col("vec_id") % 3).alias(f"{p}_f0_iqr"), (F.col("vec_id") % 10 / 10.0).alias(f"{p}_pause"), (F.col("vec_id") % 7 / 3.0).alias(f"{p}_rate"), (1.0 + F.col("vec_id") % 4).alias(f"{p}_burst"))
    first = e.groupBy("label").agg(F.min_by(F.struct("vec_id", "embedding"), "vec_id").alias("v")).select("label", "v.*")  # one reference a voice
    ref = first.select("label", F.col("vec_id").alias("ref"), *side("r"))
    return e.select("label", "vec_id", *side("c")).join(ref, "label")


_MATCH = """with f as (select label, vec_id, embedding::double[] as e, embedding[1:8]::double[] as l, case
  when vec_id % 5 <> 0 then 100.0::double + vec_id % 60 end as med, 2.0::double + vec_id % 3 as iqr,
  vec_id % 10 / 10.0::double as pause, vec_id % 7 / 3.0::double as rate, 1.0::double + vec_id % 4 as burst,
  vec_id = min(vec_id) over (partition by label) as is_ref from embeddings),
m as (select r.vec_id as ref, c.vec_id, round(0.55 * greatest(0, least(1, list_cosine_similarity(r.e, c.e))) + 0.15 * exp(-list_distance(r.l,
  c.l) / sqrt(8)) + 0.10 * coalesce(exp(-(abs(12 * log2(c.med / r.med)) / 2 + abs(c.iqr - r.iqr) / 4)), 0.5)
  + 0.20 * coalesce(exp(-(abs(c.pause - r.pause) / 0.4 + abs(c.rate - r.rate) / 1.5 + abs(c.burst - r.burst) / 3)), 0.5), 5) as score from f c
  join f r on c.label = r.label and r.is_ref)"""
add("sim_match", lambda s, d: O.match_scores(_features(s, d)).select("ref", "vec_id", "score"), f"{_MATCH} select * from m")
add(
    "top_best_match", lambda s, d: O.match_scores(_features(s, d)).where("ref <> vec_id").groupBy("ref").agg(F.max_by("vec_id", F.struct("score", "vec_id")).alias("best"), F.max("score").alias("score")),
    f"{_MATCH} select ref, arg_max(vec_id, (score, vec_id)) as best, max(score) as score from m where ref <> vec_id group by 1",
)
_GRID = {"exaggeration": [0.3, 0.5, 0.7], "cfg_weight": [0.3, 0.5, 0.7], "temperature": [0.7, 0.9]}
add("join_grid", lambda s, d: V.table(s, d, "embeddings").select("label").distinct().crossJoin(F.broadcast(O.param_grid(s, _GRID))), "select l.label, a as exaggeration, b as cfg_weight, c as temperature from (select distinct label from embeddings) l, (select unnest([0.3, 0.5, 0.7])::double as a), (select unnest([0.3, 0.5, 0.7])::double as b), (select unnest([0.7, 0.9])::double as c)")
add(
    "seg_partials", lambda s, d: V.documents(s, d).select("doc_id", F.explode(O.partial_windows(F.length("text").cast("long"))).alias("start")),
    """with n as (select doc_id, length(text) as n, greatest(length(text) - 83, 0) // 77 as w from documents), k as (select doc_id, n, w + case
  when (n - w * 77) / 160.0 >= 0.8 or w = 0 then 1 else 0 end as k from n) select doc_id, unnest(range(k)) * 77 as start from k""",
)


def _chunks(s, d):
    """A user's events as the chunks of one run: half a second of work for each; those of little value failed."""
    ms = (F.unix_micros(F.col("ts").cast("timestamp")) / 1000).cast("long")
    return V.table(s, d, "events").select(F.col("user_id").alias("run"), (ms - 700).alias("asked_ms"), ms.alias("began_ms"), F.when(F.col("value") > 50, ms + 500).alias("ended_ms"), (400 + F.col("event_id") % 800).alias("audio_ms"))


add(
    "agg_ttfa", lambda s, d: O.latency_report(_chunks(s, d)),
    """with c as (select user_id as run, epoch_us(ts) // 1000 as ms, value, 400 + event_id % 800 as audio_ms from events)
select run, min(ms + 500) - min(ms - 700) as first_ms, round(count(*) * 500.0::double / sum(audio_ms), 6) as rtf from c where value > 50 group by 1""",
)


def _plan(s, d):
    at = segments(s, d).groupBy("character").agg((F.sum(F.col("e_ms") - F.col("s_ms")) / 1000).alias("seconds"))
    return at.withColumn("status", F.when(F.col("seconds") >= 3600, "portrayed").when(F.col("seconds") > 0, "thin").otherwise("absent"))


add(
    "agg_cast_plan", lambda s, d: O.cast_plan_summary(_plan(s, d)),
    f"""with {SEGMENTS}, c as (select character, sum(e_ms - s_ms) / 1000.0::double as seconds from segments group by 1)
select case when seconds >= 3600 then 'portrayed' when seconds > 0 then 'thin' else 'absent' end as status, count(*) as n, round(sum(seconds), 3) as seconds from c group by 1""",
)
_OWN = {"temperature": [0.6, 0.8], "seed": [1, 2, 3]}
add(
    "udf_grid", lambda s, d: O.param_grid(s, _OWN).crossJoin(frames(s, d).select((F.col("clip") % 70).alias("voice")).distinct()),
    "select v.voice, t as temperature, e as seed from (select distinct user_id % 70 as voice from events) v, (select unnest([0.6, 0.8])::double as t), (select unnest([1, 2, 3])::bigint as e)",
)
