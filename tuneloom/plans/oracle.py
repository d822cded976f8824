"""The same results in ANSI SQL, for DuckDB on the same tables."""

from __future__ import annotations

from tuneloom.plans.views import many_keywords

SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
BREAK = r"\r\n|[\n\x0b\x0c\r\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]"


def _tokens(text: str) -> str:
    return f"list_filter(string_split_regex({text}, '{SPACE}+'), lambda x: x <> '')"


ALPACA = f"""alpaca as (
  select doc_id, 'Below is an instruction that describes a task'
    || case when body <> '' then ', paired with an input that provides further context' else '' end
    || '. Write a response that appropriately completes the request.' || chr(10) || chr(10)
    || '### Instruction:' || chr(10) || 'Summarise text in ' || lang || chr(10) || chr(10)
    || case when body <> '' then '### Input:' || chr(10) || body || chr(10) || chr(10) else '' end
    || '### Response:' || chr(10) || source as text
  from (select *, case when doc_id % 3 <> 0
          then regexp_replace(text, '^{SPACE}+|{SPACE}+$', '', 'g') else '' end as body
        from documents))"""

LENGTH = f"greatest(0.0::double, 1.0::double - abs(len({_tokens('completion')}) - 150)::double / 150.0::double)"
REGEX = r"case when regexp_matches(completion, '\n[\p{L}\p{N}_]+ on ') then 1.0::double else 0.0::double end"
CONTAINS = (
    "(contains(lower(completion), 'tion')::int + contains(lower(completion), 'ing')::int"
    " + contains(lower(completion), 'zebra')::int)::double / 3.0::double"
)
ANSWERS = "answers as (select conv_id, turn, text as completion from conversations where role = 'assistant')"
PAIRS = """pairs as (
  select conv_id, turn, prompt, text as completion from (
    select *, lag(text) over (partition by conv_id order by turn) as prompt,
      row_number() over (partition by conv_id order by turn) as nth
    from conversations)
  where role = 'assistant' and nth > 1)"""
SCORED = f"""{PAIRS}, scored as (
  select *, r1 + 0.5 * r2 + 0.25 * r3 as total from (
    select conv_id, turn, prompt, completion, {LENGTH} as r1, {REGEX} as r2, {CONTAINS} as r3 from pairs))"""
SAMPLES = f"""{SCORED}, samples as (
  select 'run' as run_id, conv_id // 10 as step, conv_id * 1000 + turn as pos, prompt, completion,
    u.i as reward_index, u.n as reward_name, u.r as reward
  from (select *, unnest([{{'i': 0, 'n': 'length_reward', 'r': r1}}, {{'i': 1, 'n': 'regex_format_reward', 'r': r2}},
                          {{'i': 2, 'n': 'contains_reward', 'r': r3}}]) as u from scored)),
captured as (
  select * from samples
  qualify row_number() over (partition by run_id, step, reward_name order by pos) <= 4)"""
LOGS = """logs as (
  select user_id as run_id, event_id as seq, event_type as kind, cast(props->>'k' as bigint) as step,
    case when event_type in ('view', 'purchase') then value end as loss,
    case when event_type = 'click' then value end as reward
  from events),
points as (select * from logs where kind in ('view', 'purchase', 'click')),
begins as (select run_id, max(seq) as b from logs where kind = 'signup' group by run_id),
alive as (
  select p.* from points p left join begins using (run_id) where b is null or seq > b)"""
POINT = "run_id, seq, step, loss, reward"
RING = f"""with {LOGS} select {POINT} from alive
qualify row_number() over (partition by run_id order by seq desc) <= 3"""
LATEST = f"""with {LOGS} select {POINT} from alive
qualify row_number() over (partition by run_id order by seq desc) = 1"""
MANIFEST = """manifest as (
  select user_id as run_id, event_type <> 'view' as is_dir,
    case event_type when 'purchase' then 'checkpoint-' || event_id when 'click' then 'checkpoint-foo' else 'logs' end as path
  from events),
saved as (
  select run_id, path, cast(regexp_extract(path, '^checkpoint-([0-9]+)$', 1) as bigint) as number
  from manifest where is_dir and regexp_matches(path, '^checkpoint-([0-9]+)$'))"""


def _schedule(seed: int, epochs: float, batch: int, accumulation: int, max_steps: str | int | None = None) -> str:
    per_step = batch * accumulation
    cap = f"ceil({epochs} * spe)" if max_steps is None else str(max_steps)
    return f"""with sized as (
  select *, ceil(count(*) over () / {per_step}.0) as spe from (select doc_id from documents)),
placed as (
  select doc_id, epoch, spe,
    row_number() over (partition by epoch order by md5(({seed} + epoch) || ':' || doc_id), doc_id) - 1 as pos
  from sized, unnest(range(0, ceil({cap} / spe)::bigint)) as e(epoch))
select doc_id, epoch::bigint as epoch, pos::bigint as pos, (pos // {batch})::bigint as micro_batch,
  (epoch * spe + pos // {per_step})::bigint as step
from placed where epoch * spe + pos // {per_step} < {cap}"""


def _permuted_schedule(seed: int, epochs: float, batch: int, accumulation: int) -> str:
    """The walk over the grid as a recursive query, a row a move."""
    per_step = batch * accumulation

    def shift(coordinate: str, turn: int) -> str:
        return f"('0x' || substr(md5(({seed} + epoch) || ':{turn}:' || {coordinate}), 1, 12))::bigint"

    moves = "select *, cell // width as y0, cell % width as x0 from walk where moves = 0 or cell >= n"
    for turn, of, by, size in ((0, "y0", "x0", "height"), (1, "x0", "y1", "width"), (2, "y1", "x1", "height"), (3, "x1", "y2", "width")):
        name = of[0] + str(int(of[1]) + 1)
        moves = f"select *, ({of} + {shift(by, turn)}) % {size} as {name} from ({moves})"
    return f"""with recursive counted as (
  select doc_id, row_number() over (order by md5('{seed}:' || doc_id), doc_id) - 1 as cell, count(*) over () as n from documents),
sized as (
  select *, ceil(n / {per_step}.0) as spe, floor(sqrt(n - 1))::bigint + 1 as height,
    ceil(n / (floor(sqrt(n - 1)) + 1))::bigint as width from counted),
walk as (
  select doc_id, epoch, spe, n, height, width, cell, 0 as moves
  from sized, unnest(range(0, ceil(ceil({epochs} * spe) / spe)::bigint)) as e(epoch)
  union all
  select doc_id, epoch, spe, n, height, width, y2 * width + x2, moves + 1 from ({moves}))
select doc_id, epoch::bigint as epoch, cell::bigint as pos, (cell // {batch})::bigint as micro_batch,
  (epoch * spe + cell // {per_step})::bigint as step
from walk where moves > 0 and cell < n and epoch * spe + cell // {per_step} < ceil({epochs} * spe)"""


def _reward(name: str, expression: str) -> str:
    return f"with {ANSWERS} select conv_id, turn, {expression} as {name} from answers"


def oracle_sql() -> dict[str, str]:
    alpaca = f"with {ALPACA} select doc_id, text from alpaca"
    return {
        "split_slice": "select * from documents order by doc_id limit 300 offset 200",
        "split_percent": """select doc_id, n_chars from (
              select *, row_number() over (order by doc_id) - 1 as pos, count(*) over () as n from documents)
            where pos >= round_even(n * 10 / 100.0, 0) and pos < n - round_even(n * 25 / 100.0, 0)""",
        "max_samples": "select * from documents order by doc_id limit 100 offset 50",
        "preview_json": """select doc_id, substr(to_json(d)::varchar, 1, 200) as row_json
            from documents d order by doc_id limit 5""",
        "preview_formatted": f"""with {ALPACA}
            select string_agg(substr(text, 1, 400), chr(10) || chr(10) || '---' || chr(10) || chr(10) order by doc_id) as preview
            from (select * from alpaca order by doc_id limit 5)""",
        "sink_summary": f"""with {ALPACA}
            select count(*)::bigint as n_rows, sum(length(text))::bigint as n_chars from alpaca""",
        "column_map_completion": "select doc_id, source || text as text from documents",
        "column_map_clash": "select doc_id, text as body, source as label, n_chars from documents",
        "prompt_rename": "select doc_id, text as prompt from documents",
        "fmt_alpaca": alpaca,
        "fmt_raw_text": "select doc_id, text from documents",
        "fmt_missing_fields": """select doc_id, case when doc_id % 3 <> 0 then source else '' end
              || case when doc_id % 2 <> 0 then text else '' end as text from documents""",
        "metric_points_keys": """select user_id as run_id, event_id as seq, null::double as loss, value as reward
            from events where event_type in ('view', 'purchase')""",
        "run_status_done": """with runs as (
              select user_id as run_id, coalesce(max(event_id) filter (event_type = 'signup'), -1) as b,
                coalesce(max(event_id) filter (event_type = 'error'), -1) as f,
                coalesce(max(event_id) filter (event_type = 'purchase'), -1) as e from events group by user_id)
            select run_id, case when b >= 0 and b > greatest(e, f) then 'running' when f > b then 'error'
              when e > b then 'done' else 'idle' end as status from runs""",
        "stream_restart": "select doc_id, text from documents",
        "fmt_sharegpt_plain": """select conv_id, string_agg(
              upper(substr(role, 1, 1)) || lower(substr(role, 2)) || ': ' || text, chr(10) order by turn) as text
            from conversations group by conv_id""",
        "fmt_sharegpt_chat": """select conv_id, string_agg(
              '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) as text
            from conversations group by conv_id""",
        "fmt_chat_template": """select conv_id, string_agg(role || ': ' || text, chr(10) order by turn) as text
            from conversations group by conv_id""",
        "fmt_chat_layouts": """with spoken as (
              select conv_id, role, trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body,
                row_number() over (partition by conv_id order by turn) as nth from conversations),
            heads as (select conv_id, body as told from spoken where nth = 1 and role = 'system'),
            judged as (
              select *, bool_and(role = case when p % 2 = 1 then 'user' else 'assistant' end) over (partition by conv_id) as fits
              from (select s.*, told, nth - (told is not null)::int as p from spoken s left join heads using (conv_id)) s
              where p > 0),
            ordered as (
              select conv_id,
                case when any_value(fits) then string_agg(case when role = 'user' then '<s>[INST] '
                  || case when p = 1 and told is not null then '<<SYS>>' || chr(10) || told || chr(10) || '<</SYS>>' || chr(10) || chr(10) else '' end
                  || body || ' [/INST]' else ' ' || body || ' </s>' end, '' order by nth) end as inst_tags,
                case when any_value(fits) then '<bos>' || string_agg('<start_of_turn>' || case when role = 'assistant' then 'model' else role end || chr(10)
                  || case when p = 1 and told is not null then told || chr(10) || chr(10) else '' end
                  || body || '<end_of_turn>' || chr(10), '' order by nth) end as turn_tags
              from judged group by conv_id)
            select conv_id, inst_tags, turn_tags, header_tags
            from (select conv_id, '<|begin_of_text|>' || string_agg(
                '<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || body || '<|eot_id|>', '' order by nth) as header_tags
              from spoken group by conv_id) left join ordered using (conv_id)""",
        "truncate_tokens": f"""select doc_id,
              case when len(t) > 128 then array_to_string(t[1:128], ' ') else text end as text,
              len(t)::bigint as n_tokens, len(t) > 128 as was_truncated
            from (select doc_id, text, {_tokens('text')} as t from documents)""",
        "reward_length": _reward("length_reward", LENGTH),
        "reward_regex": _reward("regex_format_reward", REGEX),
        "reward_contains": _reward("contains_reward", CONTAINS),
        "reward_documents": f"""with answers as (select doc_id, text as completion from documents),
            scored as (select doc_id, {LENGTH} as length_reward, {REGEX} as regex_format_reward,
              {CONTAINS} as contains_reward from answers)
            select *, 1.0::double * length_reward + 0.5::double * regex_format_reward
              + 0.25::double * contains_reward as total_reward from scored""",
        "reward_flatten": """select conv_id, string_agg(text, chr(10) order by turn) as flat
            from conversations group by conv_id""",
        "reward_user_udf": f"""with {PAIRS}, words as (
              select conv_id, turn, list_distinct({_tokens('prompt')}) as p, list_distinct({_tokens('completion')}) as c
              from pairs)
            select conv_id, turn, round(case when len(p) = 0 then 0.0::double
              else 2.0::double * len(list_intersect(p, c))::double / len(p)::double end, 6) as shared_words from words""",
        "reward_user_columns": f"""with {PAIRS}
            select conv_id, turn, round(length(completion)::double / (1 + turn)::double, 6) as long_for_turn from pairs""",
        "reward_group_udf": f"""with {PAIRS}, shares as (
              select conv_id, count(distinct completion)::double / count(*)::double as share from pairs group by 1)
            select p.conv_id, p.turn, round(s.share, 6) as distinct_share from pairs p join shares s using (conv_id)""",
        "reward_flatten_mixed": f"""with lists as (
              select conv_id, list(role order by turn) as r, list(text order by turn) as t from conversations group by conv_id),
            flat as (
              select conv_id, case conv_id % 9 when 1 then array_to_string(t, chr(10)) when 2 then array_to_string(t, chr(10))
                when 0 then t[1] when 3 then t[1] when 4 then '{{"role":"' || r[1] || '"}}'
                when 5 then t[1] || chr(10) || t[-1] || chr(10) || '7' || chr(10) || 'True' || chr(10) || chr(10) || '[1,"a"]' || chr(10) || chr(10) || '2.5'
                when 7 then 'not JSON {{' else '' end as completion from lists)
            select conv_id, completion as flat, {LENGTH} as length_reward from flat""",
        "fmt_mixed_rows": """select conv_id, case when conv_id % 3 = 2 then '' else string_agg(
              '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' order by turn) end as text
            from conversations group by conv_id""",
        "reward_contains_many": f"""select doc_id, round(len(list_filter({many_keywords()!r}, lambda w: contains(lower(text), lower(w))))::double
              / {len(many_keywords())}::double, 6) as contains_reward from documents""",
        "reward_group_lists": f"""with {PAIRS}, ranked as (
              select conv_id, turn, rank() over (partition by conv_id order by length(completion)) - 1 as shorter,
                count(*) over (partition by conv_id) as n from pairs)
            select conv_id, turn, round(shorter::double / n::double, 6) as share_shorter from ranked""",
        "reward_group_stream": """select doc_id, source, case when length(text) > coalesce(max(length(text)) over (
                partition by source order by doc_id rows between unbounded preceding and 1 preceding), -1)
              then 1.0::double else 0.0::double end as longer_than_before from documents""",
        "reward_group_merge": """select doc_id, source, round(case when min(length(text)) over g = max(length(text)) over g then 0.0::double
              else (length(text) - min(length(text)) over g)::double / (max(length(text)) over g - min(length(text)) over g)::double end, 6) as relative_length
            from documents window g as (partition by source)""",
        "scored_job": """with texts as (
              select doc_id, source, text || case when doc_id % 2 = 0 then '</answer>' else '' end as completion from documents),
            shares as (select source, count(distinct completion)::double / count(*)::double as share from texts group by source),
            scored as (
              select doc_id, source, contains(lower(completion), '</answer>')::int::double as contains_reward, share,
                contains(lower(completion), '</answer>')::int::double + 0.5 * share as total
              from texts join shares using (source))
            select doc_id, contains_reward, round(share, 6) as distinct_share, round(total, 6) as total_reward,
              round(case when min(total) over g = max(total) over g then 0.0::double
                else (total - avg(total) over g) / stddev_samp(total) over g end, 6) as advantage
            from scored window g as (partition by source)""",
        "reward_regex_json": """select event_id as seq, case when regexp_matches(event_type || ' ' || props, '(?i:purchase)(?s:.*)\\{"k": ?[0-9]{0,3}\\}')
              then 1.0::double else 0.0::double end as regex_format_reward from events""",
        "sink_rows": alpaca,
        "config_split": """select doc_id, text, lang as config, 'test' as split from documents
            where lang = 'en' and source in ('src1', 'src2', 'src3') order by doc_id limit 50 offset 10""",
        "stream_named": "select doc_id, text from documents where lang = 'de' and source not in ('src1', 'src2', 'src3')",
        "zip_arrays": """with lists as (select doc_id, string_split(text, ' ') as w, string_split(text, chr(10)) as l from documents)
            select doc_id, pos::bigint as pos, w[pos + 1] as word, l[pos + 1] as line
            from lists, unnest(range(0, least(len(w), len(l)))) as e(pos)""",
        "metric_ring_full": f"""with {LOGS}, merged as (select *, run_id % 3 as run from points)
            select run as run_id, seq, step, loss, reward from merged
            qualify row_number() over (partition by run order by seq desc) <= 10000""",
        "log_tail_full": """select user_id % 3 as run_id, string_agg(
              '[' || strftime(ts, '%H:%M:%S') || '] ' || event_type || ' ' || props, chr(10) order by event_id) as log_text
            from (select * from events qualify row_number() over (partition by user_id % 3 order by event_id desc) <= 500)
            group by user_id % 3""",
        "step_schedule_long": _schedule(3, 1, 4, 2, "ceil(2.4 * spe)"),
        "prompt_expand": """select conv_id, turn, text as prompt, g::bigint as gen_idx
            from conversations, unnest(range(0, 4)) as e(g) where role = 'user'""",
        "pair_join": f"""with {ANSWERS}, firsts as (
              select conv_id, arg_min(text, turn) as prompt from conversations where role = 'user' group by conv_id)
            select conv_id, prompt, turn, completion from answers join firsts using (conv_id)""",
        "pair_turns": f"with {PAIRS} select conv_id, turn, prompt, completion from pairs",
        "zip_shortest": """with numbered as (
              select *, row_number() over (partition by conv_id, role order by turn) - 1 as pos from conversations)
            select u.conv_id, u.pos, u.text as prompt, a.text as completion
            from numbered u join numbered a on u.conv_id = a.conv_id and u.pos = a.pos
            where u.role = 'user' and a.role = 'assistant'""",
        "weighted_rewards": f"""with {SCORED} select conv_id, turn, r1 as length_reward, r2 as regex_format_reward,
              r3 as contains_reward, round(total, 6) as total_reward from scored""",
        "group_relative_advantage": f"""with {SCORED}
            select conv_id, turn, round(r1, 6) as length_reward, round(r2, 6) as regex_format_reward,
              round(r3, 6) as contains_reward, round(total, 6) as total_reward,
              round(case when min(total) over g = max(total) over g then 0.0::double
                else (total - avg(total) over g) / stddev_samp(total) over g end, 6) as advantage
            from scored window g as (partition by conv_id)""",
        "mean_reward_by_step": f"""with {SAMPLES}
            select run_id, step, reward_name, round(avg(reward), 6) as mean_reward, count(reward)::bigint as n_rewards
            from samples group by 1, 2, 3""",
        "capture_per_step": f"""with {SAMPLES}
            select step, reward_name, pos, prompt, completion, reward from captured""",
        "recent_samples": f"""with {SAMPLES}
            select step, reward_name, pos, prompt, completion, reward from captured
            order by captured.step desc, reward_index desc, captured.pos desc limit 20""",
        "sample_table": f"""with {SAMPLES}
            select step, reward_name, pos, substr(prompt, 1, 120) as prompt, substr(completion, 1, 160) as completion,
              round_even(reward, 3) as reward from captured""",
        "metric_points": f"with {LOGS} select {POINT} from points",
        "metric_ring": RING,
        "metric_latest": LATEST,
        "loss_curve": f"with {LOGS} select run_id, seq, step, loss from points where loss is not null and step % 5 = 0",
        "reward_curve": f"with {LOGS} select run_id, seq, step, reward from points where reward is not null",
        "log_tail": """select user_id as run_id, string_agg(
              '[' || strftime(ts, '%H:%M:%S') || '] ' || event_type || ' ' || props, chr(10) order by event_id) as log_text
            from (select * from events qualify row_number() over (partition by user_id order by event_id desc) <= 20)
            group by user_id""",
        "trace_tail": f"""select doc_id, generate_subscripts(tail, 1)::bigint as line_no, unnest(tail) as line from (
              select doc_id, l[greatest(1, len(l) - 7):len(l)] as tail from (
                select doc_id, case when l[-1] = '' then l[1:len(l) - 1] else l end as l from (
                  select doc_id, string_split_regex(text, '{BREAK}') as l from documents)))""",
        "run_status": f"""with {LOGS}, runs as (
              select run_id, coalesce(max(seq) filter (kind = 'signup'), -1) as b,
                coalesce(max(seq) filter (kind = 'error'), -1) as f,
                max(seq) filter (kind in ('view', 'purchase', 'click')) as p from logs group by run_id)
            select r.run_id, case when b >= 0 and b > f then 'running' when f > b then 'error' else 'idle' end as status,
              coalesce(case when p > b then l.step end, -1) as step, case when p > b then l.loss end as loss
            from runs r left join logs l on l.run_id = r.run_id and l.seq = r.p""",
        "run_summary": f"""with {LOGS}
            select run_id, max(step) as steps, arg_max(loss, step * 1000000000 + seq) filter (loss is not null) as final_loss,
              count(*)::bigint as n_points,
              count(distinct case when reward is not null then step // 34 end)::bigint as num_rewards
            from points group by run_id""",
        "latest_checkpoint": f"""with {MANIFEST}
            select run_id, arg_max(path, number) as path, coalesce(max(number), -1) as number
            from (select distinct run_id from manifest) left join saved using (run_id) group by run_id""",
        "checkpoint_retention": f"""with {MANIFEST}
            select run_id, path, number,
              case when row_number() over (partition by run_id order by number desc) <= 2 then 'keep' else 'drop' end as action
            from saved""",
        "batch_plan": """with placed as (
              select doc_id, row_number() over (order by md5('42:' || doc_id), doc_id) - 1 as pos from documents)
            select doc_id, pos::bigint as pos, (pos // 2)::bigint as micro_batch, (pos // 8)::bigint as step from placed""",
        "step_schedule": _schedule(42, 1.5, 2, 4),
        "step_schedule_capped": _schedule(7, 3, 1, 4, 20),
        "step_schedule_permuted": _permuted_schedule(11, 3.5, 2, 4),
        "stream_format": alpaca,
        "stream_score": f"""with {ANSWERS} select conv_id, turn, {LENGTH} as length_reward,
            {REGEX} as regex_format_reward, {CONTAINS} as contains_reward from answers""",
        "stream_capture": f"""with {ANSWERS}, scored as (
              select *, {LENGTH} as r1, {REGEX} as r2, {CONTAINS} as r3 from answers),
            samples as (
              select conv_id // 10 as step, conv_id * 1000 + turn as pos, completion, u.n as reward_name, u.r as reward
              from (select *, unnest([{{'n': 'length_reward', 'r': r1}}, {{'n': 'regex_format_reward', 'r': r2}},
                                      {{'n': 'contains_reward', 'r': r3}}]) as u from scored))
            select step, reward_name, pos, completion, reward from samples
            qualify row_number() over (partition by step, reward_name order by pos) <= 4""",
        "stream_log": """select user_id as run_id, string_agg(
              '[' || strftime(ts, '%H:%M:%S') || '] ' || event_type || ' ' || props, chr(10) order by event_id) as log_text
            from (select * from events qualify row_number() over (partition by user_id order by event_id desc) <= 20)
            group by user_id""",
        "stream_curve": f"""with {SAMPLES}
            select run_id, step, reward_name, round(avg(reward), 6) as mean_reward, count(reward)::bigint as n_rewards
            from samples group by 1, 2, 3""",
        "stream_ring_expiry": f"""with {LOGS},
            heard as (select user_id as run_id, max(ts) as last from events where event_type <> 'error' group by user_id),
            newest as (
              select alive.*, e.ts from alive join events e on e.event_id = seq
              where run_id in (select run_id from heard where last >= (select max(last) from heard) - interval 6 hour)
              qualify row_number() over (partition by run_id order by seq desc) <= 3),
            silences as (select *, ts - lag(ts) over (partition by run_id order by ts, seq) > interval 6 hour as silent from newest),
            begun as (select *, max(case when silent then ts end) over (partition by run_id) as since from silences)
            select {POINT} from begun where since is null or ts >= since""",
        "job_resumed": f"""with plan as ({_schedule(42, 1.5, 2, 4)})
            select doc_id, epoch, pos, step, len({_tokens('text')})::bigint as n_tokens from plan join documents using (doc_id)""",
        "stream_latest": LATEST,
        "stream_ring": RING,
    }
