"""The queries as SQL over the same tables, for an independent engine (DuckDB).

The texts share no code with the operators, and state what a request is answered with: no caps beyond those that a
query is about, one transcript per clip, refused requests as rows. Windows run over whole keys and pairs are compared
by brute force.
"""

from __future__ import annotations

# Input tables, as in `fixtures`.
_NUMBERED_EVENTS = "row_number() over (partition by user_id order by ts, event_id) - 1"
_NUMBERED_LINES = (
    "row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity) - 1"
)

TABLES: dict[str, str] = {
    "fx_videos": """
        select p_partkey as video_id,
               case when p_partkey % 13 = 0 then null else cast((p_partkey * 37) % 6000 as double) / 10e0 end as probe_duration,
               case when p_partkey % 17 = 0 then null else cast(200 + p_size * 37 as int) end as width,
               case when p_partkey % 17 = 0 then null else cast(300 + p_size * 61 as int) end as height,
               cast(500 + (p_partkey * 7919) % 5000 as bigint) as bytes,
               case p_partkey % 3 when 0 then null when 1 then '  ' else p_name end as brief
        from part""",
    "fx_words": f"""
        with w as (select user_id as video_id, event_type, value, event_id, {_NUMBERED_EVENTS} as word_idx from events)
        select video_id, word_idx,
               case when event_id % 29 = 0 then '  ' else concat(' ', event_type) end as word,
               case when event_id % 31 = 0 then null else word_idx * 0.4e0 end as start_s,
               word_idx * 0.4e0 + case when event_type = 'error' then 0e0 else least(value, 350e0) / 1000e0 end as end_s
        from w""",
    "fx_segments": f"""
        select user_id as video_id, {_NUMBERED_EVENTS} as seg_idx, concat(' ', event_type, ' ') as text,
               case when event_id % 7 = 0 then null else cast(event_id % 10 as double) / 10e0 end as no_speech_prob,
               case when event_id % 5 = 0 then null else 0e0 - value / 50e0 end as avg_logprob,
               case when event_id % 3 = 0 then null
                    else 1e0 + cast(regexp_extract(props, '([0-9]+)', 1) as double) / 50e0 end as compression_ratio
        from events""",
    "fx_cues": f"""
        select user_id as reel_id, {_NUMBERED_EVENTS} as cue_idx,
               case when event_id % 19 = 0 then '   ' else concat(event_type, ' ', cast(event_id as varchar)) end as text,
               case when event_id % 23 = 0 then 'abc' when event_id % 37 = 0 then null else cast(event_id % 60 as varchar) end as start_raw,
               cast((event_id % 60) + (event_id % 4) as varchar) as end_raw
        from events""",
    "fx_shots": f"""
        select l_orderkey as reel_id, {_NUMBERED_LINES} as shot_idx,
               case when l_linenumber = 7 then null else concat('shots/', cast(l_partkey as varchar)) end as url,
               case when l_returnflag = 'R' then 'video' else 'still' end as kind,
               l_quantity / 4e0 as seconds,
               case when l_linestatus = 'F' then l_discount * 1000e0 else null end as start_at,
               l_suppkey % 9 <> 0 as fetched
        from lineitem""",
    "fx_detections": f"""
        select l_orderkey as frame_id, {_NUMBERED_LINES} as det_idx,
               10e0 as x1, 20e0 as y1, 10e0 + l_quantity as x2, 20e0 + cast(l_linenumber as double) * 3e0 as y2
        from lineitem""",
    "fx_frames": "select o_orderkey as frame_id, o_custkey as job_id, o_orderkey % 23 <> 0 as readable from orders",
    "fx_urls": """
        select page_id,
               case page_id % 7 when 0 then concat('https://www.instagram.com/reel/', cast(page_id as varchar), '/')
                                when 1 then concat('https://www.tiktok.com/@u/video/', cast(page_id as varchar))
                                when 2 then concat('https://www.tiktok.com/t/', cast(page_id as varchar))
                                when 3 then concat('https://instagram.com/stories/', cast(page_id as varchar))
                                when 4 then '  ' else url end as url,
               case when page_id % 4 = 0 then 'video/mp4' when page_id % 4 = 1 then 'text/html; charset=utf-8'
                    when page_id % 4 = 2 then null else 'application/octet-stream' end as content_type,
               case when page_id % 3 = 0 then 'ftypmp42' when page_id % 3 = 1 then substring(html, 1, 20) else '<html>' end as head,
               cast(case page_id % 13 when 0 then 62914560 when 1 then 62914561 when 2 then 209715200 when 3 then 209715201
                                      when 4 then 314572800 when 5 then 314572801 when 6 then 999 when 7 then 1000 when 8 then 1001
                                      when 9 then 1999 else length(html) end as bigint) as bytes
        from pages""",
    "fx_fetch_errors": """
        select event_id,
               case event_id % 10 when 0 then 'not_found' when 1 then 'restricted_page' when 2 then ''
                    when 3 then null when 4 then 'Post not found or private' when 5 then 'Post DELETED, login required'
                    when 6 then 'empty message' when 7 then 'HTTP 403' when 8 then 'no results' else 'timeout' end as error,
               case when event_id % 2 = 0 then 'geoblock' else null end as error_description
        from events""",
    "fx_lane_responses": """
        select conv_id, turn,
               concat(case conv_id % 4 when 0 then concat('LANE: AUTHENTIC', chr(10)) when 1 then concat('lane: high-end', chr(10))
                                       when 2 then concat('LANE: OTHER', chr(10)) else '' end,
                      case turn % 3 when 0 then concat('TALKING: YES', chr(10), chr(10)) when 1 then concat('talking: no', chr(10)) else '' end,
                      text) as response
        from conversations""",
    "fx_section_responses": """
        select conv_id, turn,
               concat(case when conv_id % 5 = 0 then '' else concat('ANALYSIS', chr(10)) end, 'summary ', cast(conv_id as varchar), chr(10),
                      'PROMPT A | warm', chr(10), 'first body ', cast(turn as varchar), chr(10),
                      case conv_id % 3 when 0 then concat('PROMPT B', chr(10), 'second body', chr(10))
                                       when 1 then concat('PROMPT B | empty', chr(10)) else '' end) as response
        from conversations""",
    "fx_job_events": """
        select event_id, user_id as job_id, ts as created_at,
               case event_type when 'signup' then 'downloading' when 'view' then 'extracting_frames' when 'click' then 'processing'
                               when 'purchase' then 'done' else 'error' end as step
        from events""",
    "fx_artifacts": "select *, concat_ws('_', 'art', cast(job_id as varchar), step) as token from fx_job_events",
    "fx_registry_log": """
        select registry, concat('key_', case when event_type = 'click' and event_id % 7 = 0 then -1 else user_id % 15 end) as key, event_id, ts as moment,
               case registry when 'artifacts' then event_type = 'signup' else event_type = 'error' end as sweeps,
               case registry when 'artifacts' then event_type in ('signup', 'purchase') else event_type = 'error' end as registers,
               event_type in ('view', 'click') as reads,
               case registry when 'artifacts' then interval 30 minutes else interval 60 minutes end as lifetime
        from events, (values ('artifacts'), ('jobs')) as registries(registry)""",
    "fx_metadata": """
        select p_partkey as video_id,
               case p_partkey % 5 when 0 then 'make' when 1 then 'model' when 2 then 'creation_time' when 3 then 'location' else 'x-evil' end as key,
               case p_partkey % 7 when 0 then null when 1 then '   ' when 2 then concat(' ', p_name, chr(10), p_brand, ' ')
                                  when 3 then repeat('z', 300) when 4 then concat(chr(9), chr(1)) else p_name end as value
        from part""",
    "fx_params": """
        select o_orderkey as req_id,
               case o_orderkey % 9 when 0 then null when 1 then '0' when 2 then '-4' when 3 then 'abc' when 4 then '6.7'
                                   when 5 then '12abc' when 6 then '' when 7 then '999' else cast(o_orderkey % 15 as varchar) end as raw
        from orders""",
    # Plans and operators that other queries build on.
    "clips": """
        select video_id, probe_duration, width, height, bytes, brief, duration, fps,
               cast(least(80, floor(duration * fps + 0.5)) as bigint) as n_frames
        from (select *, least(8e0, 80e0 / greatest(duration, 0.1e0)) as fps
              from (select *, coalesce(nullif(probe_duration, 0), 15e0) as duration from fx_videos))""",
    "plan_params": "select req_id, raw, coalesce(probe_duration, 0e0) as seconds from fx_params left join fx_videos on video_id = req_id",
    "scored": """
        select *, trim(text) as clean,
               coalesce(no_speech_prob, 0) < 0.6e0 and coalesce(avg_logprob, 0) > -1e0 and coalesce(compression_ratio, 1) < 2.4e0 as keep
        from fx_segments""",
    "transcripts": """
        select video_id,
               coalesce(string_agg(clean, ' ' order by seg_idx) filter (where keep and clean <> ''), '') as text,
               count(*) filter (where keep) as kept, count(*) filter (where not keep) as rejected
        from scored group by all""",
    "clean_words": """
        select video_id, word_idx, trim(word) as word, coalesce(start_s, 0e0) as start_s, coalesce(end_s, 0e0) as end_s
        from fx_words where trim(word) <> ''""",
    "chunks": """
        select video_id, word_idx // 3 as chunk_idx, string_agg(trim(word), ' ' order by word_idx) as text,
               arg_min_null(start_s, word_idx) as start_s, arg_max_null(end_s, word_idx) as end_s
        from fx_words group by all""",
    "checked_chunks": "select *, coalesce(trim(text) <> '' and end_s > start_s, false) as usable from chunks",
    "cue_numbers": """
        select reel_id, cue_idx, trim(text) as text,
               case when start_raw is null then 0e0 else try_cast(start_raw as double) end as start_s,
               try_cast(end_raw as double) as end_s
        from fx_cues""",
    "good_cues": "select * from cue_numbers where text <> '' and start_s is not null and end_s > start_s",
    "requested": """
        select reel_id, shot_idx, url, kind, fetched,
               least(10e0, greatest(0.3e0, coalesce(nullif(seconds, 0), 1e0))) as seconds,
               least(60e0, greatest(0e0, coalesce(start_at, 0e0))) as start_at
        from fx_shots where url is not null""",
    "summary": """
        select *, case when requested < 2 then 'too_few_requested' when prepared < 2 then 'too_few_prepared' else 'ok' end as status
        from (select o_orderkey as reel_id, count(shot_idx) as requested, count(*) filter (where fetched) as prepared,
                     round(sum(case when fetched then seconds else 0e0 end), 6) as seconds
              from orders left join requested r on r.reel_id = o_orderkey group by o_orderkey)""",
    "timeline": """
        select reel_id, shot_idx, kind, seconds, start_at, end_s - seconds as start_s, end_s
        from (select *, sum(seconds) over (partition by reel_id order by shot_idx rows unbounded preceding) as end_s
              from requested where fetched and reel_id in (select reel_id from summary where status = 'ok'))""",
    "sources": """
        select o_orderkey as reel_id, shot_idx, url, count(shot_idx) over (partition by o_orderkey) as sources
        from orders left join (select * from fx_shots where trim(coalesce(url, '')) <> '') s on s.reel_id = o_orderkey""",
    "pixels": """
        select vec_id // 15 as video_id, vec_id % 15 as frame_idx, y, x,
               floor(least(greatest(128e0 + 400e0 * cast(embedding[y + 1] as double) * cast(embedding[33 + x] as double), 0e0), 255e0)) as v
        from embeddings, range(32) as ys(y), range(32) as xs(x)""",
    "edited": """
        select video_id * 3 + kind as clip_id, frame_idx, y, x,
               case kind when 0 then v when 1 then v + 5 else v + 12 * ((7 * x + 13 * y) % 5) end as v
        from pixels, range(3) as kinds(kind)""",
    "lines": "select clip_id, frame_idx, y, "
    + ", ".join(f"sum(v * cos((2 * x + 1) * {u} * pi() / 64)) as r{u}" for u in range(8))
    + " from edited group by clip_id, frame_idx, y",
    "coefs": "select clip_id, frame_idx, ["
    + ", ".join(f"sum(r{v} * cos((2 * y + 1) * {u} * pi() / 64))" for u in range(8) for v in range(8))
    + "] as cs from lines group by clip_id, frame_idx",
    "coef_rows": "select clip_id, frame_idx, i, cs[i + 1] as c from coefs, range(64) as places(i)",
    "middles": """
        select clip_id, frame_idx, avg(c) as middle
        from (select *, row_number() over (partition by clip_id, frame_idx order by c) as place from coef_rows where i > 0)
        where place in (31, 32) group by all""",
    "hashes": """
        select clip_id, frame_idx, cast(case when h >= 9223372036854775808 then h - 18446744073709551616 else h end as bigint) as phash
        from (select clip_id, frame_idx, sum(case when c > middle then cast(power(2, 63 - i) as hugeint) else 0 end) as h
              from coef_rows join middles using (clip_id, frame_idx) group by all)""",
    "pairs": """
        select video_id * 3 as base_id, cast(i as bigint) as index,
               case when i <= 3 then video_id * 3 + i - 1 else (video_id + i - 3) * 3 end as candidate_id
        from (select distinct vec_id // 15 as video_id from embeddings), range(1, 13) as places(i)""",
    "distances": """
        select p.base_id, p.index, p.candidate_id, nullif(count(d), 0) as frames_compared, avg(d) as mean_distance, max(d) as max_distance
        from pairs p left join (
            select base_id, index, cast(bit_count(xor(a.phash, b.phash)) as bigint) as d
            from pairs join hashes a on a.clip_id = base_id join hashes b on b.clip_id = candidate_id and b.frame_idx = a.frame_idx
        ) d on d.base_id = p.base_id and d.index = p.index
        group by all""",
    "results": """
        select *, case verdict when 'would still match' then 'A dedup system would very likely treat this as the same video.'
                               when 'borderline' then 'Close enough that a match is plausible.'
                               when 'likely distinct' then 'Far enough apart that a perceptual match is unlikely.' end as detail
        from (select base_id, index, candidate_id, (select count(*) from hashes where clip_id = base_id) as base_frames, frames_compared,
                     floor(mean_distance * 100 + 0.5) / 100 as avg_distance, max_distance,
                     case when mean_distance <= 10 then 'would still match' when mean_distance <= 20 then 'borderline'
                          when mean_distance is not null then 'likely distinct' end as verdict,
                     case when frames_compared is null then 'No frames hashed' end as error
              from distances)""",
    "job_states": """
        select job_id, arg_max(step, (created_at, event_id)) as step, max(created_at) as updated_at, count(*) as events
        from fx_job_events group by job_id""",
    "job_starts": """
        select job_id, min(created_at) as created_at from fx_job_events group by job_id
        union all
        select s.job_id, min(e.created_at) from job_starts s join fx_job_events e on e.job_id = s.job_id and e.created_at > s.created_at + interval 60 minutes
        group by s.job_id""",
    "clock": "select date_trunc('millisecond', max(ts)) - interval 10 minutes as now from events",
}

_STATUS = "case when step in ('done', 'error') then step else 'processing' end"
_WINDOWED = """
    select {start} as window_start, {start} + interval 1 hour as window_end,
           count(*) as events, count(*) filter (where step = 'downloading') as started
    from {source} group by all"""


def _even(x: str) -> str:
    return f"cast(greatest(2, floor(({x}) / 2e0 + 0.5) * 2) as bigint)"


def _int_param(default: int, low: int, high: int) -> str:
    digits = "try_cast(regexp_extract(raw, '^\\s*([+-]?[0-9]+)', 1) as bigint)"
    return f"cast(least({high}, greatest({low}, coalesce(nullif({digits}, 0), {default}))) as bigint)"


_PLATFORM = r"""case when url is null or url = '' then null
    when regexp_matches(url, 'instagram\.com/(p|reel|reels)/') then 'instagram'
    when regexp_matches(url, 'tiktok\.com/@[^/]+/video/|tiktok\.com/t/') then 'tiktok' else 'direct' end"""

_HEADER = r"""
    select conv_id, turn, coalesce(nullif(upper(lane), ''), 'AUTHENTIC') as lane, upper(talk) = 'YES' as talking,
           case when talk = '' then rest else trim(regexp_replace(rest, '(?i)^TALKING:\s*(YES|NO)\s*\n+', ''), blanks) end as body,
           case when answer = '' then 'Empty response' end as error
    from (select *, regexp_extract(rest, '(?i)^TALKING:\s*(YES|NO)\s*\n+', 1) as talk
          from (select *, case when lane = '' then answer
                          else trim(regexp_replace(answer, '(?i)^LANE:\s*(AUTHENTIC|HIGH-END)\s*\n+', ''), blanks) end as rest
                from (select *, regexp_extract(answer, '(?i)^LANE:\s*(AUTHENTIC|HIGH-END)\s*\n+', 1) as lane
                      from (select conv_id, turn, trim(response, blanks) as answer, blanks
                            from fx_lane_responses, (select concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13), chr(160)) as blanks)))))"""

_PLAN_SAMPLED = """
    select video_id, n_frames, fps, i, case when n_frames <= {keep} then i
           else cast(floor(i * (n_frames - 1) / {last}e0 + 0.5) as bigint) end as frame_idx
    from clips, range({keep}) as places(i) where i < n_frames"""

QUERIES: dict[str, str] = {
    "scan_requests": """
        select req_id,
               case when req_id % 10 <> 3 and req_id % 11 <> 0 then concat('v', req_id) end as video_url,
               case when req_id % 10 = 3 then null when req_id % 11 = 0 then coalesce(raw, '') else raw end as frames,
               case when req_id % 10 = 3 then 'bad_json' when req_id % 11 = 0 then 'missing_video_url' end as reject_reason
        from fx_params""",
    "scan_transcripts": """
        select doc_id as response_id, i as word_idx, ws[i + 1] as word, i * 0.4e0 as start_s, i * 0.4e0 + 0.3e0 as end_s
        from (select doc_id, string_split(text, ' ') as ws from documents), unnest(range(len(ws))) as places(i)""",
    "probe_video_stream": """
        select video_id,
               cast(case when video_id % 4 = 2 then 0 else coalesce(width, 0) end as bigint) as width,
               cast(case when video_id % 4 = 2 then 0 else coalesce(height, 0) end as bigint) as height,
               case when video_id % 4 = 2 then 'No video stream found' end as error
        from fx_videos""",
    "sink_results": """
        select video_id,
               case when probe_duration is null then '{"success":false,"error":"probe failed"}'
                    else concat('{"success":true,"durationSec":', cast(floor(duration * 10 + 0.5) / 10 as varchar),
                                case when width is null then '' else concat(',"width":', width) end, '}') end as envelope
        from clips""",
    "sink_runs": """
        select video_id, case when probe_duration is null then 'failed' else 'ok' end as state,
               case when probe_duration is null then 'again' else concat('first ', probe_duration) end as result,
               cast(case when probe_duration is null then 2 else 1 end as bigint) as run_number
        from clips""",
    "frame_data_url": "select doc_id, concat('data:image/jpeg;base64,', to_base64(encode(text))) as data_url from documents",
    "url_route": f"""
        select page_id, platform,
               case platform when 'instagram' then 'scraper' when 'tiktok' then 'downloader' when 'direct' then 'http' end as fetcher,
               case when platform = 'instagram' then 'scraper' when platform is not null then 'downloader' end as hosting_fetcher
        from (select page_id, {_PLATFORM} as platform from fx_urls)""",
    "payload_guard": f"""
        select page_id,
               case when platform <> 'tiktok' and bytes > 209715200 then 'too_large'
                    when platform = 'direct' and (coalesce(contains(content_type, 'text/html'), false)
                                                  or starts_with(head, '<!') or starts_with(head, '<h')) then 'html_page'
                    when platform <> 'direct' and bytes < 1000 then 'too_small' end as analysis_reject,
               case when platform = 'direct' and bytes > 314572800 or platform = 'instagram' and bytes > 209715200 then 'too_large'
                    when bytes < 1000 then 'too_small' end as audio_reject,
               case when bytes > 1000 then 'usable' else 'silent' end as speech_track,
               case when bytes >= 2000 then 'usable' else 'no_audio' end as extracted_track,
               case when bytes <= 62914560 then 'usable' else 'too_large' end as timing_track
        from (select *, {_PLATFORM} as platform from fx_urls)""",
    "fetch_error_reason": """
        select event_id, reason,
               case reason when 'not_found' then 'This Instagram post no longer exists — it was deleted or the link is wrong.'
                           when 'restricted_page' then 'This account is private or restricted, so the post cannot be fetched.'
                           else 'Could not find this Instagram post — it may be private, deleted, or the link is invalid.' end as message
        from (select event_id,
                     case when regexp_matches(raw, 'not_?found|no results|does not exist|deleted|removed|no longer available|404') then 'not_found'
                          when regexp_matches(raw, 'restrict|private|login|unavailable|age|gated|geoblock|forbidden|403|sign in') then 'restricted_page'
                          else 'unknown' end as reason
              from (select event_id, lower(coalesce(nullif(error, ''), error_description, '')) as raw from fx_fetch_errors))""",
    "speech_segments": "select video_id, seg_idx, text from scored where keep",
    "word_normalize": "select * from clean_words",
    "usable_cues_strict": "select video_id, chunk_idx, text, start_s, end_s from checked_chunks where usable",
    "usable_cues_coerced": "select * from good_cues",
    "valid_sources": "select *, sources >= 2 as accepted from sources",
    "match_verdict": "select base_id, index, verdict, detail from results",
    "plan_dense": """
        select video_id, i, i / fps as ts, concat('frame-', lpad(cast(i + 1 as varchar), 3, '0'), '.jpg') as name
        from clips, unnest(range(n_frames)) as places(i)""",
    "plan_picker": "select video_id, i, frame_idx, floor(frame_idx / fps * 10 + 0.5) / 10 as ts from ("
    + _PLAN_SAMPLED.format(keep=12, last=11)
    + ")",
    "plan_vision_cap": """
        select video_id, i, frame_idx,
               case when n_frames > 20 then ' (20 representative frames shown, evenly sampled from the full clip.)' else '' end as note
        from ("""
    + _PLAN_SAMPLED.format(keep=20, last=19)
    + ")",
    "plan_hook": """
        select video_id, i, ts from clips, (values (0::bigint, 0.3e0), (1::bigint, 1e0), (2::bigint, 2e0), (3::bigint, 3e0)) as stamps(i, ts)
        where ts < duration""",
    "plan_opening": """
        select video_id, case when duration > 0.1e0 then 0.1e0 else 0e0 end as ts,
               case when duration > 0.1e0 then 'opening' else 'picker' end as source
        from clips""",
    "plan_interior": f"""
        select req_id, i, floor(exact * 1000 + 0.5) / 1000 as seek, floor(exact * 100 + 0.5) / 100 as ts
        from (select req_id, i, greatest(0.05e0, (case when seconds > 0.2e0 then seconds else 1e0 end) * ((i + 1) / (n + 1))) as exact
              from (select *, {_int_param(3, 1, 5)} as n from plan_params), unnest(range(n)) as places(i))""",
    "plan_hash": f"""
        select req_id, i, floor(exact * 1000000 + 0.5) / 1000000 as rate, floor(i / exact * 1000000 + 0.5) / 1000000 as ts
        from (select *, case when seconds > 0.1e0 then n / seconds else 1e0 end as exact
              from (select *, {_int_param(6, 3, 12)} as n from plan_params)), unnest(range(n)) as places(i)""",
    "plan_fixed_rate": """
        select video_id, count(*) as frames, cast(sum(i) as bigint) as index_sum, round(sum(i) / 24e0, 3) as ts_sum, max(i) / 24e0 as last_ts,
               cast(sum(i + 1) as bigint) as name_sum, cast(sum(length(name)) as bigint) as name_length
        from (select video_id, i, concat('frame_', lpad(cast(i + 1 as varchar), cast(greatest(4, length(cast(i + 1 as varchar))) as int), '0'), '.jpg') as name
              from clips, unnest(range(cast(floor(duration * 24) as bigint))) as places(i))
        group by video_id""",
    "plan_still_zoom": """
        select reel_id, shot_idx, count(*) as frames, cast(sum(i) as bigint) as index_sum, round(sum(zoom), 6) as zoom_sum,
               round(sum(zoom * i), 4) as zoom_moment, round(min(zoom), 6) as first_zoom, round(max(zoom), 6) as last_zoom
        from (select reel_id, shot_idx, i, least(1e0 + 0.0015e0 * (i + 1), 1.1e0) as zoom
              from (select reel_id, shot_idx, least(10e0, greatest(0.3e0, coalesce(nullif(seconds, 0), 1e0))) as secs
                    from fx_shots where kind = 'still' and url is not null),
                   unnest(range(cast(greatest(2, floor(secs * 24 + 0.5)) as bigint))) as places(i))
        group by all""",
    "param_clamp": f"""
        select req_id, {_int_param(3, 1, 5)} as frames, {_int_param(60, 5, 120)} as audio_seconds,
               {_int_param(6, 3, 12)} as hash_frames, {_int_param(3, 1, 10)} as copies
        from fx_params""",
    "shot_clamp": """
        select reel_id, shot_idx, least(10e0, greatest(0.3e0, coalesce(nullif(seconds, 0), 1e0))) as seconds,
               least(60e0, greatest(0e0, coalesce(start_at, 0e0))) as start_at,
               least(15e0, greatest(0e0, coalesce(start_at, 0e0))) as delay
        from fx_shots""",
    "output_canvas": f"""
        select video_id,
               cast(case when fits then w else 1080 end as bigint) as stitch_w, cast(case when fits then h else 1920 end as bigint) as stitch_h,
               {_even('coalesce(nullif(width, 0), 1080)')} as reel_w, {_even('coalesce(nullif(height, 0), 1920)')} as reel_h
        from (select *, coalesce(w between 128 and 2160 and h between 128 and 3840 and width > 0 and height > 0, false) as fits
              from (select *, {_even('width')} as w, {_even('height')} as h from fx_videos))""",
    "letterbox_geometry": """
        select video_id, fit_w, fit_h, cast(floor((1080 - fit_w) / 2e0) as bigint) as pad_x, cast(floor((1920 - fit_h) / 2e0) as bigint) as pad_y
        from (select video_id, cast(floor(width * s + 0.5) as bigint) as fit_w, cast(floor(height * s + 0.5) as bigint) as fit_h
              from (select *, case when width is not null then least(1080e0 / width, 1920e0 / height) end as s from fx_videos))""",
    "caption_style": """
        select video_id,
               case video_id % 6 when 0 then 0.014e0 when 2 then 0.022e0 when 3 then 0.028e0 else 0.0175e0 end as ratio,
               case video_id % 4 when 0 then 'middle' when 1 then 'bottom' else 'lower' end as position,
               case video_id % 4 when 0 then null
                    when 1 then round(0.14e0 * coalesce(nullif(height, 0), 1920), 6)
                    else round(0.26e0 * coalesce(nullif(height, 0), 1920), 6) end as margin,
               case video_id % 5 when 1 then 'clean' when 2 then 'typewriter' else 'strong' end as font
        from fx_videos""",
    "caption_font_size": """
        select video_id, source, longest, font_px, cast(floor(font_px * border + 0.5) as bigint) as border_px
        from (select *, cast(greatest(16, least(floor(h * ratio + 0.5), floor((w * 0.92e0) / (longest * 0.62e0)))) as bigint) as font_px
              from (select l.*, case when source = 'chunks' then 0.0175e0
                                     else case video_id % 6 when 0 then 0.014e0 when 2 then 0.022e0 when 3 then 0.028e0 else 0.0175e0 end end as ratio,
                           case when width > 0 then width else 1080 end as w, case when height > 0 then height else 1920 end as h
                    from (select video_id, 'chunks' as source, 0.12e0 as border, greatest(max(length(text)), 1) as longest from chunks group by video_id
                          union all
                          select reel_id, 'cues', 0.14e0, max(length(text)) from good_cues group by reel_id) l
                         left join fx_videos using (video_id)))""",
    "meta_sanitize": r"""
        select video_id, key, nullif(substring(trim(regexp_replace(value, '[\x00-\x1f\x7f]', '', 'g')), 1, 256), '') as clean
        from fx_metadata""",
    "meta_allowlist": r"""
        select video_id,
               cast((key in ('make', 'model', 'creation_time') and clean is not null)::int + (video_id % 2 = 0)::int as bigint) as keys_kept,
               case when key = 'make' then clean end as make, case when key = 'model' then clean end as model,
               case when key = 'creation_time' then clean end as creation_time,
               case when not (key in ('make', 'model', 'creation_time') and clean is not null) and video_id % 2 <> 0
                    then 'No recognised metadata keys supplied' end as error
        from (select *, nullif(substring(trim(regexp_replace(value, '[\x00-\x1f\x7f]', '', 'g')), 1, 256), '') as clean from fx_metadata)""",
    "llm_header_parse": _HEADER,
    "llm_sections": r"""
        select conv_id, turn, analysis, cast(row_number() over (partition by conv_id, turn order by prompt_id) - 1 as bigint) as pos,
               prompt_id, label, body
        from (select conv_id, turn, concat('summary ', conv_id) as analysis, 'A' as prompt_id, 'warm' as label, concat('first body ', turn) as body
              from fx_section_responses
              union all
              select conv_id, turn, concat('summary ', conv_id), 'B', '', 'second body' from fx_section_responses where conv_id % 3 = 0)""",
    "prompt_compose": f"""
        select conv_id, turn,
               concat_ws(' ', body, case lane when 'AUTHENTIC' then 'Handheld phone look.' else 'Cinema camera look.' end, 'Keep the setting.') as prompt
        from ({_HEADER}) where error is null""",
    "error_message": """
        select event_id,
               coalesce(case event_id % 3 when 0 then nullif(error, '')
                                          when 1 then coalesce(nullif(error_description, ''), nullif(error, '')) end, 'request failed') as message,
               cast(case event_id % 4 when 0 then 404 when 3 then 503 else 500 end as bigint) as status
        from fx_fetch_errors""",
    "text_truncate": """
        select doc_id, substring(text, 1, 500) as prompt_text, substring(text, 1, 200) as error_text, substring(text, 1, 60) as log_text
        from documents""",
    "metadata_summary": """
        select video_id, concat(cast(floor(duration + 0.5) as bigint), 's') as duration, floor(duration * 10 + 0.5) / 10 as seconds_1,
               floor(coalesce(probe_duration, 0e0) * 100 + 0.5) / 100 as seconds_2, n_frames as frame_count, coalesce(has_audio, false) as has_audio
        from clips left join (select video_id, bool_or(keep and clean <> '') as has_audio from scored group by video_id) using (video_id)""",
    "iso_utc_timestamp": """
        select event_id, concat(strftime(ts, '%Y-%m-%dT%H:%M:%S.'), lpad(cast(epoch_us(ts) // 1000 % 1000 as varchar), 3, '0'), 'Z') as stamp from events""",
    "artifact_key": """
        select event_id,
               concat(case step when 'downloading' then 'room' when 'extracting_frames' then 'cap' when 'processing' then 'seq'
                                when 'done' then 'reel' else 'stamp' end,
                      '_', epoch_us(created_at) // 1000, '_', substring(sha256(cast(event_id as varchar)), 1, 6)) as artifact_key
        from fx_job_events""",
    "size_delta": """
        select video_id, bytes as in_bytes, out_bytes, out_bytes - bytes as delta
        from fx_videos left join (select p_partkey as video_id, cast(400 + (p_partkey * 7919) % 5000 + p_size * 7 as bigint) as out_bytes
                                  from part where p_partkey % 11 <> 0) using (video_id)""",
    "candidate_pairs": "select * from pairs",
    "phash_compare": "select * from results",
    "near_duplicates": """
        with signatures as (select clip_id, string_agg(phash, ',' order by frame_idx) as signature from hashes group by clip_id),
        firsts as (select signature, min(clip_id) as clip_id, count(*) as copies from signatures group by signature),
        near as (
            select a.clip_id, b.clip_id as other_id, avg(bit_count(xor(x.phash, y.phash))) as mean
            from firsts a join firsts b on a.clip_id <> b.clip_id
            join hashes x on x.clip_id = a.clip_id join hashes y on y.clip_id = b.clip_id and y.frame_idx = x.frame_idx
            group by all having avg(bit_count(xor(x.phash, y.phash))) <= 10)
        select a.clip_id, any_value(a.copies) as copies, count(o.clip_id) as near_signatures, cast(coalesce(sum(o.copies), 0) as bigint) as near_clips,
               arg_min(other_id, (mean, other_id)) as nearest_id, round(min(mean), 6) as nearest_mean
        from firsts a left join near n on n.clip_id = a.clip_id left join firsts o on o.clip_id = other_id
        group by a.clip_id""",
    "near_duplicate_members": """
        with signatures as (select clip_id, string_agg(phash, ',' order by frame_idx) as signature from hashes group by clip_id)
        select clip_id, min(clip_id) over same as class_id, count(*) over same as copies
        from signatures window same as (partition by signature)""",
    "near_duplicate_pairs": """
        with signatures as (select clip_id, string_agg(phash, ',' order by frame_idx) as signature from hashes group by clip_id),
        firsts as (select min(clip_id) as clip_id from signatures group by signature)
        select a.clip_id as class_id, b.clip_id as other_id, round(avg(bit_count(xor(x.phash, y.phash))), 6) as mean_distance
        from firsts a join firsts b on a.clip_id < b.clip_id
        join hashes x on x.clip_id = a.clip_id join hashes y on y.clip_id = b.clip_id and y.frame_idx = x.frame_idx
        group by all having avg(bit_count(xor(x.phash, y.phash))) <= 10""",
    "near_duplicate_arrivals": """
        with comers as (select clip_id, clip_id // 2 % 3 + 1 as arrival from (select distinct clip_id from hashes)),
        near as (
            select a.clip_id as one, b.clip_id as other, greatest(a.arrival, b.arrival) as since
            from comers a join comers b on a.clip_id <> b.clip_id
            join hashes x on x.clip_id = a.clip_id join hashes y on y.clip_id = b.clip_id and y.frame_idx = x.frame_idx
            group by all having avg(bit_count(xor(x.phash, y.phash))) <= 10),
        reached as (
            select clip_id, clip_id as other, k from comers, range(1, 4) as ks(k) where arrival <= k
            union
            select r.clip_id, n.other, k from reached r join near n on n.one = r.other and since <= k),
        named as (select clip_id, k, min(other) as group_id, count(*) as group_clips from reached group by all)
        select clip_id, cast(arrival as bigint) as arrival, a.group_id as group_then, b.group_id, b.group_clips
        from comers join named a using (clip_id) join named b using (clip_id) where a.k = arrival and b.k = 3""",
    "cue_frame_overlay": """
        select reel_id, frame_idx, cue_idx
        from good_cues join summary s using (reel_id),
             unnest(range(cast(floor(s.seconds * 24) as bigint))) as frames(frame_idx)
        where status = 'ok' and frame_idx / 24e0 >= start_s and frame_idx / 24e0 <= end_s""",
    "cue_overlay_runs": """
        select reel_id, min(frame_idx) as first_frame, max(frame_idx) as last_frame, cues
        from (select *, frame_idx - row_number() over (partition by reel_id, cues order by frame_idx) as island
              from (select reel_id, frame_idx, string_agg(cue_idx, ',' order by cue_idx) as cues
                    from good_cues join summary s using (reel_id), unnest(range(cast(floor(s.seconds * 24) as bigint))) as frames(frame_idx)
                    where status = 'ok' and frame_idx / 24e0 >= start_s and frame_idx / 24e0 <= end_s
                    group by reel_id, frame_idx))
        group by reel_id, cues, island""",
    "voice_over_fit": """
        with voiced as (
            select reel_id, seconds as picture_s, case reel_id % 5 when 1 then 0.5e0 when 2 then 15e0 when 4 then 2.25e0 else 0e0 end as delay_s
            from summary where status = 'ok' and reel_id % 4 not in (0, 1)),
        spoken as (select reel_id, picture_s, w.start_s + delay_s as start_s, greatest(w.end_s, w.start_s) + delay_s as end_s
                   from voiced join clean_words w on w.video_id = reel_id),
        totals as (select reel_id, max(end_s) as voice_end, count(*) as words, count(*) filter (where start_s >= picture_s) as cut_words,
                          count(*) filter (where start_s < picture_s and end_s > picture_s) as clipped_words from spoken group by reel_id),
        heard as (select reel_id, start_s, least(end_s, picture_s) as end_s from spoken where start_s < picture_s),
        joined as (select reel_id, span, min(start_s) as start_s, max(end_s) as end_s
                   from (select *, sum(opens) over (partition by reel_id order by start_s, end_s rows unbounded preceding) as span
                         from (select *, case when start_s <= max(end_s) over (partition by reel_id order by start_s, end_s
                                                                            rows between unbounded preceding and 1 preceding) then 0 else 1 end as opens
                               from heard)) group by reel_id, span),
        apart as (select reel_id, count(*) filter (where silence > 0.3e0) + 1 as islands, sum(end_s - start_s) as speech_s,
                         greatest(coalesce(max(silence), 0e0), min(start_s)) as gap_s, max(end_s) as heard_until
                  from (select *, start_s - lag(end_s) over (partition by reel_id order by start_s) as silence from joined) group by reel_id)
        select reel_id, round(picture_s, 6) as picture_s, delay_s, round(coalesce(voice_end, delay_s), 6) as voice_end_s,
               round(greatest(picture_s - coalesce(voice_end, delay_s), 0e0), 6) as pad_s, round(greatest(coalesce(voice_end, delay_s) - picture_s, 0e0), 6) as cut_s,
               coalesce(words, 0) as words, coalesce(cut_words, 0) as cut_words, coalesce(clipped_words, 0) as clipped_words,
               coalesce(islands, 0) as islands, round(coalesce(speech_s, 0e0), 6) as speech_s,
               round(greatest(coalesce(gap_s, 0e0), picture_s - coalesce(heard_until, 0e0)), 6) as longest_silence_s
        from voiced left join totals using (reel_id) left join apart using (reel_id)""",
    "word_shot_alignment": """
        select video_id, word_idx, word, round(moment, 6) as at, shot_idx, shot_idx is not null as heard
        from (select w.*, w.start_s + case when o_orderkey is null then 0e0
                                           else case o_orderkey % 5 when 1 then 0.5e0 when 2 then 15e0 when 4 then 2.25e0 else 0e0 end end as moment
              from clean_words w left join orders on o_orderkey = video_id) w
             left join timeline t on t.reel_id = w.video_id and moment >= t.start_s and moment < t.end_s""",
    "profile_lookup": """
        select event_id, case when event_type = 'error' then 'room' else asked end as profile, bed,
               case when bed is null then null when sent is not null then sent else bed_db end as level_db, bed is not null as phone
        from (select event_id, event_type,
                     case event_type when 'signup' then 'studio' when 'view' then 'car' when 'click' then 'cafe' when 'purchase' then 'gym' end as asked,
                     case event_type when 'signup' then null
                          when 'view' then 'anoisesrc=color=brown:amplitude=0.9,lowpass=f=320'
                          when 'click' then 'anoisesrc=color=pink:amplitude=0.9,highpass=f=300,lowpass=f=2500'
                          when 'purchase' then 'anoisesrc=color=brown:amplitude=0.9,lowpass=f=500'
                          else 'anoisesrc=color=brown:amplitude=0.9,lowpass=f=250' end as bed,
                     case event_type when 'view' then -26e0 when 'click' then -28e0 when 'purchase' then -27e0 when 'error' then -34e0 end as bed_db,
                     case event_id % 5 when 1 then 0e0 when 2 then -30e0 when 4 then -12.5e0 end as sent
              from events)""",
    "known_jobs": f"""
        select job_id, step, {_STATUS} as status, {_STATUS} = 'done' as ready
        from job_states where job_id in (select c_custkey from customer)""",
    "missing_jobs": "select c_custkey as job_id from customer where c_custkey not in (select job_id from fx_job_events)",
    "failed_shots": "select reel_id, shot_idx, url from requested where not fetched",
    "transcript_assemble": """
        select video_id, text, kept, rejected, text <> '' as has_audio from transcripts
        union all
        select -1 - doc_id, coalesce(text, ''), 0, 0, coalesce(text, '') <> '' from documents""",
    "caption_chunks": "select * from checked_chunks",
    "caption_longest": """
        select video_id, longest, longest_cue
        from (select video_id, max(length(text)) as longest from chunks group by video_id)
             full join (select reel_id as video_id, max(length(text)) as longest_cue from good_cues group by reel_id) using (video_id)""",
    "phash64": "select * from hashes",
    "phash64_relational": "select * from hashes",
    "phash_distance_stats": """
        select base_id, index, candidate_id, frames_compared, round(mean_distance, 6) as mean_distance, max_distance
        from distances""",
    "largest_detection": """
        select f.frame_id, case when readable then coalesce(boxes, 0) else 0 end as boxes,
               case when readable then det_idx end as det_idx, case when readable then x1 end as x1, case when readable then y1 end as y1,
               case when readable then x2 end as x2, case when readable then y2 end as y2
        from fx_frames f left join (
            select *, count(*) over (partition by frame_id) as boxes,
                   row_number() over (partition by frame_id order by (x2 - x1) * (y2 - y1) desc, det_idx) as place
            from fx_detections) d on d.frame_id = f.frame_id and place = 1""",
    "detection_coverage": """
        select job_id, count(*) as total, count(*) filter (where hit) as swappable, round(count(*) filter (where hit) / count(*), 6) as coverage
        from (select job_id, frame_id in (select frame_id from fx_detections) and readable as hit from fx_frames) group by job_id""",
    "reel_summary": """
        select s.*, reel_id % 4 not in (0, 1) as has_audio, status = 'ok' and reel_id in (select reel_id from good_cues) as captions_burned,
               case when status = 'ok' and reel_id in (select reel_id from fx_cues) and reel_id not in (select reel_id from good_cues)
                    then 'no usable cues' end as caption_error
        from summary s""",
    "speech_coverage": """
        select video_id, coalesce(last_end, 0e0) as last_end, coalesce(probe_duration, 0e0) as duration,
               round(coalesce(probe_duration, 0e0) - coalesce(last_end, 0e0), 6) as trailing_silence
        from fx_videos left join (select video_id, max(end_s) as last_end from clean_words group by video_id) using (video_id)""",
    "vision_request_bundle": """
        with lists as (
            select video_id, 'gateway' as route, string_agg(frame_idx, ',' order by i) as frame_list from ("""
    + _PLAN_SAMPLED.format(keep=20, last=19)
    + """) group by video_id
            union all
            select video_id, 'direct', string_agg(i, ',' order by i) from clips, unnest(range(n_frames)) as places(i) group by video_id)
        select video_id, route, kind, n_frames, frame_list,
               concat('These ', n_frames, case kind when 'background' then concat(
                          ' frames were extracted from my own source video. Its exact duration is ',
                          regexp_replace(cast(floor(duration * 10 + 0.5) / 10 as varchar), '[.]0$', ''),
                          ' seconds — use this figure, do not estimate.', chr(10), chr(10), 'The background change I want: ',
                          coalesce(nullif(trim(brief), ''), '(none specified — ask one clarifying question in the ANALYSIS instead of guessing)'))
                      else concat(' frames were extracted from the video', case when text is null then ' (no audio). Describe the clip.'
                          else concat('. Transcript: "', text, '"', chr(10), chr(10), 'Describe the clip.') end) end,
                      case when n_frames > 20 and route = 'gateway'
                           then ' (20 representative frames shown, evenly sampled from the full clip.)' else '' end) as request_text
        from clips join lists using (video_id) left join (select video_id, text from transcripts where text <> '') using (video_id),
             (values ('describe'), ('background')) as kinds(kind)""",
    "shot_timeline": """
        select reel_id, shot_idx, kind, seconds, start_at, round(start_s, 6) as start_s, round(end_s, 6) as end_s from timeline""",
    "stitch_order": """
        select reel_id, row_number() over (partition by reel_id order by shot_idx) as clip_order, url, sources as clip_count
        from sources where sources >= 2""",
    "cap_per_group": """
        select reel_id, cue_idx, text, cap
        from fx_cues join (values ('sources', 6), ('candidates', 10), ('shots', 40), ('cues', 200)) as caps(cap, most) on cue_idx < most""",
    "progress_marks": """
        select job_id, done, total, concat(done, '/', total, ' frames') as mark
        from (select job_id, readable, row_number() over (partition by job_id order by frame_id) as done, count(*) over (partition by job_id) as total
              from fx_frames)
        where readable and (done % 20 = 0 or done = total)""",
    "frame_name_order": """
        select video_id, name, row_number() over (partition by video_id order by name) - 1 as place
        from (select video_id, concat('frame-', lpad(cast(i + 1 as varchar), 3, '0'), '.jpg') as name from clips, unnest(range(n_frames)) as places(i))""",
    "image_file_filter": """
        select * from (select doc_id, concat(lang, '_', doc_id, case doc_id % 6 when 0 then '.jpg' when 1 then '.JPEG' when 2 then '.png'
                                             when 3 then '.gif' when 4 then '.jpg.tmp' else '.PnG' end) as name from documents)
        where doc_id % 6 not in (3, 4)""",
    "compare_results_union": """
        select * exclude (index), cast(case when index <= 3 then index - 1 else index - 3 end as bigint) as index,
               case when index <= 3 then 'edits' else 'neighbours' end as list
        from results where index between 2 and 6
        order by base_id, list, index""",
    "artifact_expiry": """
        select token, max(created_at) as created_at, max(created_at) < any_value(now) - interval 30 minutes as expired
        from fx_artifacts, clock group by token""",
    "job_expiry": """
        select job_id, max(created_at) as created_at, max(created_at) < any_value(now) - interval 60 minutes as expired
        from job_starts, clock group by job_id""",
    "job_lifetimes": f"""
        select *, {_STATUS} as status
        from (select job_id, opened as created_at, max(created_at) as updated_at, arg_max(step, (created_at, event_id)) as step, count(*) as events
              from (select e.*, (select max(s.created_at) from job_starts s where s.job_id = e.job_id and s.created_at <= e.created_at) as opened
                    from fx_job_events e)
              group by job_id, opened)""",
    "registry_reads": """
        select registry, key, event_id, moment as read_at, case when served then registered_at end as registered_at, swept_at, served,
               case when served then 200 else 404 end as status
        from (select *, registered_at is not null and not coalesce(registered_at < swept_at - lifetime, false) as served
              from (select r.*, (select max(e.moment) from fx_registry_log e where e.registers and e.registry = r.registry and e.key = r.key
                                   and (e.moment < r.moment or e.moment = r.moment and e.event_id <= r.event_id)) as registered_at,
                           (select max(s.moment) from fx_registry_log s where s.sweeps and s.registry = r.registry
                                   and (s.moment < r.moment or s.moment = r.moment and s.event_id <= r.event_id)) as swept_at
                    from fx_registry_log r where r.reads))""",
    "registry_lifetimes": """
        select registry, key, event_id, moment as registered_at, least(swept_at, replaced_at) as served_until,
               case when swept_at <= coalesce(replaced_at, swept_at) then 'swept' when replaced_at is not null then 'replaced' else 'alive' end as fate
        from (select e.*, (select min(n.moment) from fx_registry_log n where n.registers and n.registry = e.registry and n.key = e.key
                             and (n.moment > e.moment or n.moment = e.moment and n.event_id > e.event_id)) as replaced_at,
                     (select min(s.moment) from fx_registry_log s where s.sweeps and s.registry = e.registry and s.moment > e.moment + e.lifetime) as swept_at
              from fx_registry_log e where e.registers)""",
    "job_latest_state": f"select *, {_STATUS} as status from job_states",
    "artifact_dedup": """
        select token, created_at, event_id, step
        from (select *, row_number() over (partition by token order by created_at, event_id) as place from fx_artifacts) where place = 1""",
    "job_activity_window": _WINDOWED.format(start="date_trunc('hour', created_at)", source="fx_job_events"),
    "job_activity_sliding": _WINDOWED.format(
        start="time_bucket(interval 15 minutes, created_at) - back * interval 15 minutes", source="fx_job_events, range(4) as slides(back)"
    ),
    "job_activity_session": """
        select job_id, min(created_at) as session_start, max(created_at) + interval 30 minutes as session_end, count(*) as events
        from (select *, sum(opens) over (partition by job_id order by created_at, event_id rows unbounded preceding) as session
              from (select *, case when lag(created_at) over line is null or created_at >= lag(created_at) over line + interval 30 minutes
                                   then 1 else 0 end as opens
                    from fx_job_events window line as (partition by job_id order by created_at, event_id)))
        group by job_id, session""",
    "seeded_sample": """
        with texts as (select o_orderkey, concat('run::', o_orderkey) as s from orders),
        h0 as (select o_orderkey, list_reduce([cast(ascii(c) as bigint) for c in string_split(s, '')], lambda a, b: (a * 31 + b) % 4294967296) as h from texts),
        h1 as (select o_orderkey, xor(h, h >> 16) as h from h0),
        h2 as (select o_orderkey, cast((cast(h as hugeint) * 2246822507) % 4294967296 as bigint) as h from h1),
        h3 as (select o_orderkey, xor(h, h >> 13) as h from h2),
        h4 as (select o_orderkey, cast((cast(h as hugeint) * 3266489909) % 4294967296 as bigint) as h from h3),
        h5 as (select o_orderkey, xor(h, h >> 16) as h from h4),
        steps as (select o_orderkey, list_reduce(list_prepend(h, range(1, 14)), lambda a, b: (a * 1664525 + 1013904223) % 4294967296) as h from h5)
        select o_orderkey, h / 4294967296e0 as draw, h / 4294967296e0 < 0.1e0 as sampled from steps""",
}


# Texts that refer to themselves.
RECURSIVE = {"near_duplicate_arrivals"}


def _needed(sql: str) -> list[str]:
    """Input tables a text uses, directly or through others, in the order they are defined."""
    used = {name for name in TABLES if name in sql}
    while True:
        more = {name for name in TABLES if any(name in TABLES[u] for u in used)} | used
        if more == used:
            return [name for name in TABLES if name in used]
        used = more


def oracle_sql() -> dict[str, str]:
    """Complete SQL text of each query."""
    texts = {}
    for name, sql in QUERIES.items():
        ctes = ",\n".join(f"{t} as ({TABLES[t]})" for t in _needed(sql))
        if name in RECURSIVE or any("job_starts" in t for t in _needed(sql)):
            ctes = f"recursive {ctes}"
        body = sql.strip()
        if body.startswith("with ") and ctes:
            texts[name] = f"with {ctes},\n{body[5:]}"
        else:
            texts[name] = f"with {ctes}\n{body}" if ctes else body
    return texts
