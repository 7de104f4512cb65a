"""Operators on task tables that are plain statements, by the operator's number in the survey."""

from __future__ import annotations

import re

from .sqltext import Engine, Statement, tasks

FOUND: dict[str, Statement] = {}


def _add(name: str, body, with_tasks: bool = True) -> None:
    """Registers ``body`` (text or a function of the engine); further CTEs start with a comma."""

    def statement(e: Engine) -> str:
        text = body(e) if callable(body) else body
        text = re.sub(r"(?<![\w.'])(\d+\.\d+)(?![\w.'])", r"\1e0", text)  # doubles, not decimals of some scale
        return (f"with {tasks(e)} " if with_tasks else "") + text

    FOUND[name] = statement


# Parsing and scalar functions.
_add("fn01_numeric_parse", """, raw as (select task_id, case when task_id % 5 = 0 then 'n/a' when task_id % 5 = 1 then '' else cast(value as string) end as v from tasks)
 select task_id, try_cast(v as double) as parsed, case when try_cast(v as double) > 100 then try_cast(v as double) end as positive from raw""")
_add("fn02_duration_grammar", """, raw as (select task_id, cast(task_id % 3 as string) || 'd ' || cast(task_id % 24 as string) || 'h ' || cast(task_id % 60 as string) || 'm ' || cast(task_id % 60 as string) || '.5s ' || cast(task_id % 1000 as string) || 'ms' as v from tasks)
 select task_id, coalesce(try_cast(regexp_extract(v, '([0-9.]+) *d', 1) as double), 0) * 86400 + coalesce(try_cast(regexp_extract(v, '([0-9.]+) *h', 1) as double), 0) * 3600
  + coalesce(try_cast(regexp_extract(v, '([0-9.]+) *m( |$)', 1) as double), 0) * 60 + coalesce(try_cast(regexp_extract(v, '([0-9.]+) *s', 1) as double), 0)
  + coalesce(try_cast(regexp_extract(v, '([0-9.]+) *ms', 1) as double), 0) / 1000 as seconds from raw""")
_add("fn03_byte_size_grammar", """, raw as (select task_id, cast(task_id % 97 as string) || '.5 ' || case task_id % 4 when 0 then 'B' when 1 then 'KB' when 2 then 'MB' else 'GB' end as v from tasks)
 select task_id, cast(round(try_cast(regexp_extract(v, '^([0-9.]+)', 1) as double) * case regexp_extract(v, '([A-Z]+)$', 1) when 'B' then 1 when 'KB' then 1024 when 'MB' then 1048576 when 'GB' then 1073741824 end) as bigint) as bytes from raw""")
_add("fn04_memory_request_grammar", """, raw as (select task_id, cast(task_id % 512 + 1 as string) || case task_id % 4 when 0 then 'G' when 1 then 'M' when 2 then 'k' else '' end as v from tasks)
 select task_id, cast(ceil(try_cast(regexp_extract(v, '^([0-9]+)', 1) as double) * case lower(regexp_extract(v, '([A-Za-z]?)$', 1)) when 'g' then 1024.0 when 'k' then 1.0 / 1024 else 1.0 end) as bigint) as mib from raw""")
_add("fn05_clock_grammar", """, raw as (select task_id, case when task_id % 2 = 0 then cast(task_id % 12 as string) || ':' else '' end || cast(task_id % 60 as string) || ':' || cast(task_id % 50 + 10 as string) as v from tasks)
 select task_id, coalesce(try_cast(regexp_extract(v, '^([0-9]+):[0-9]+:', 1) as double), 0) * 3600 + try_cast(regexp_extract(v, '([0-9]+):[0-9.]+$', 1) as double) * 60 + try_cast(regexp_extract(v, ':([0-9.]+)$', 1) as double) as seconds from raw""")
_add("fn05_resident_set_line", """, raw as (select task_id, case when task_id % 11 = 0 then 'Command exited' else chr(9) || 'Maximum resident set size (kbytes): ' || cast(task_id * 37 as string) end as line from tasks)
 select task_id, try_cast(nullif(regexp_extract(line, 'Maximum resident set size .kbytes.: *([0-9]+)', 1), '') as bigint) * 1024 as bytes from raw""")
_add("fn06_process_tag_split", """, raw as (select task_id, 'MAIN:SUB:' || upper(process) || ' (' || task_instance || ')' as name from tasks)
 select task_id, regexp_extract(name, '^([^ ]+)', 1) as process, regexp_extract(name, '[(](.*)[)]$', 1) as tag, regexp_extract(name, '([^: ]+) [(]', 1) as alias from raw""")
_add("fn08_completion_time", "select task_id, coalesce(case when task_id % 4 <> 0 then completion_us end, decision_us + cast(floor(runtime_seconds * 1000000) as bigint)) as completed_us from tasks")
_add("fn10_identity_hash", lambda e: f"select task_id, substr({e.sha('workflow || chr(31) || process || chr(31) || task_instance')}, 1, 20) as identity from tasks")
_add("fn11_hash_fraction", lambda e: f"select task_id, {e.hex_to_int('substr(' + e.sha('cast(task_id as string)') + ', 1, 15)')} / 1152921504606846975.0 as fraction from tasks")
_add("fn12_clean_text", "select task_id, case when lower(trim(v)) in ('', 'nan', 'none', 'null') then null else trim(v) end as clean from (select task_id, case task_id % 4 when 0 then ' NaN ' when 1 then '' when 2 then 'None' else ' ' || workflow end as v from tasks) t")
_add("fn13_log_features", "select task_id, round(ln(1 + greatest(coalesce(consumed_bytes, 0), 0)), 9) as log_consumed, cast(case when consumed_bytes is null then 1 else 0 end as double) as missing, coalesce(case when task_id % 3 <> 0 then process end, 'unknown') as process from tasks")
_add("fn14_ceil_mib", "select task_id, cast(ceil(greatest(peak_bytes / 1048576.0, 1)) as bigint) as mib from tasks")
_add("fn15_monotone_quantiles", """, q as (select task_id, value as q50, value * (1 + (task_id % 5 - 2) / 10.0) as q90, value * (1 + (task_id % 7 - 2) / 10.0) as q99 from tasks)
 select task_id, q50, greatest(q50, q90) as q90, greatest(q50, q90, q99) as q99 from q""")
_add("fn18_input_class", "select task_id, case when coalesce(consumed_bytes, 0) > 0 and input_bytes > 2097152 then 'mixed' when coalesce(consumed_bytes, 0) > 0 then 'intermediate' when input_bytes > 0 then 'original' else 'unknown' end as input_class from tasks")
_add("fn20_static_input", "select task_id, coalesce(consumed_bytes, case when task_id % 2 = 0 then input_bytes end) as static_bytes, case when consumed_bytes is not null then 'staged_total' when task_id % 2 = 0 then 'manifest' else 'missing' end as derivation from tasks")
_add("fn21_signal_choice", "select task_id, case task_id % 3 when 0 then null when 1 then consumed_bytes else consumed_bytes + input_bytes end as signal_bytes from tasks")
_add("fn22_eligibility", "select task_id, peak_bytes > 0 and runtime_seconds is not null as model_eligible, consumed_bytes is not null and runtime_seconds is not null as audit_eligible from tasks")
_add("fn25_safe_ratio", "select task_id, case when consumed_bytes <> 0 then peak_bytes / cast(consumed_bytes as double) end as ratio, case when input_bytes <> 0 then 100.0 * (peak_bytes - input_bytes) / input_bytes end as change_pct from tasks")
_add("fn26_margin_bucket", """, r as (select task_id, workflow, cast(ceil(peak_bytes * (0.9 + (task_id % 50) / 100.0)) as bigint) as request, peak_bytes from tasks),
 b as (select workflow, case when request < peak_bytes then 'below peak' when request <= peak_bytes * 1.05 then '0-5%' when request <= peak_bytes * 1.10 then '5-10%' when request <= peak_bytes * 1.25 then '10-25%' else '>25%' end as bucket from r)
 select workflow, bucket, count(*) as n, round(count(*) * 100.0 / sum(count(*)) over (partition by workflow), 9) as share from b group by workflow, bucket""")
_add("fn27_density_label", "select workflow, process, count(*) as n, case when count(*) >= 300 then 'dense' when count(*) >= 100 then 'medium' else 'sparse' end as density from tasks group by workflow, process")

# Requests that later operators measure: 1.2 times the workflow's mean peak, and a second method.
_REQ = """, req as (select t.*, m.mean_peak * 1.2 as request_a, m.mean_peak * (1 + (task_id % 10) / 10.0) as request_b
  from tasks t join (select workflow, avg(peak_bytes) as mean_peak from tasks group by workflow) m on t.workflow = m.workflow)"""

# Joins and matching.
_add("jn01_one_to_one_join", """select o_orderkey, o_totalprice, c_name from @orders join @customer on o_custkey = c_custkey where (select count(*) = count(distinct c_custkey) from @customer)""", False)
_add("jn03_unique_candidates", """, k as (select l_partkey, l_suppkey, l_returnflag, l_quantity, count(*) over (partition by l_partkey, l_suppkey, l_returnflag) as c from @lineitem)
 select a.l_partkey, a.l_suppkey, a.l_quantity as qty_a, n.l_quantity as qty_n, r.l_quantity as qty_r
 from (select * from k where c = 1 and l_returnflag = 'A') a join (select * from k where c = 1 and l_returnflag = 'N') n on a.l_partkey = n.l_partkey and a.l_suppkey = n.l_suppkey
 left join (select * from k where c = 1 and l_returnflag = 'R') r on a.l_partkey = r.l_partkey and a.l_suppkey = r.l_suppkey""")
_add("jn05_unique_prefix_join", lambda e: f""", long as (select task_id, {e.sha('cast(task_id as string)')} as h from tasks), short as (select task_id as wanted, substr({e.sha('cast(task_id as string)')}, 1, 10) as p from tasks where task_id % 3 = 0),
 m as (select wanted, task_id, count(*) over (partition by wanted) as c from short join long on substr(h, 1, 8) = substr(p, 1, 8) and h like p || '%') select wanted, task_id from m where c = 1""")
_add("jn07_two_key_lookup", "select t.task_id, coalesce(a.c_custkey, b.c_custkey) as c_custkey from tasks t left join @customer a on t.task_id = a.c_custkey and t.task_id % 2 = 0 left join @customer b on cast(t.task_instance as bigint) = b.c_custkey")
_add("jn08_preferred_row", "select workflow, process, task_id from (select *, row_number() over (partition by workflow, process order by case when runtime_seconds is null then 0 else 1 end desc, task_id % 13 desc, task_id desc) as r from tasks) t where r = 1")
_add("jn10_semi_join", "select o_orderkey from @orders where o_orderkey in (select l_orderkey from @lineitem where l_quantity > 45)", False)
_add("jn11_overlap", "select 'both' as side, count(*) as n from (select l_partkey from @lineitem where l_returnflag = 'A' intersect select l_partkey from @lineitem where l_returnflag = 'R') x union all select 'only_a', count(*) from (select l_partkey from @lineitem where l_returnflag = 'A' except select l_partkey from @lineitem where l_returnflag = 'R') y", False)
_add("jn15_exploded_plan", lambda e: f""" select {e.sha("'i' || cast(s_suppkey as string) || '|' || r_name")} as plan_id, s_suppkey, r_name as chrom, {e.steps('1', 'cast(s_suppkey % 4 + 1 as int)')} as chunk from @supplier cross join @region""", False)
_add("jn17_paired_methods", _REQ + """, long as (select task_id, 'a' as method, request_a as request, peak_bytes as measure from req union all select task_id, 'b', request_b, peak_bytes from req)
 select task_id, max(case when method = 'a' then request end) as request_a, max(case when method = 'b' then request end) as request_b, max(measure) as measure, abs(max(measure) - min(measure)) <= 0.000001 and count(*) = 2 as equal_measures from long group by task_id""")

# Aggregations.
_add("ag01_run_summary", lambda e: f"select workflow, count(*) as n, count(distinct task_instance) as instances, count_if(consumed_bytes is not null) as covered, round(100.0 * count_if(consumed_bytes is not null) / count(*), 9) as coverage_pct, round(sum(peak_bytes) / 1073741824.0, 9) as peak_gib, {e.pct('peak_bytes', 0.5)} as median_peak from tasks group by workflow")
_add("ag02_bucket_summary", "select workflow, process, case when peak_bytes < 50000000 then 'small' else 'large' end as bucket, count(*) as n, cast(sum(peak_bytes) as bigint) as bytes from tasks group by 1, 2, 3")
_add("ag03_experiment_comparison", """, s as (select l_shipdate, l_linestatus, l_returnflag, l_quantity from @lineitem) select l_linestatus, sum(case when l_returnflag = 'N' then l_quantity end) as base, sum(case when l_returnflag = 'A' then l_quantity end) as audit_a, sum(case when l_returnflag = 'R' then l_quantity end) as audit_r,
 round(100.0 * (sum(case when l_returnflag = 'A' then l_quantity end) - sum(case when l_returnflag = 'N' then l_quantity end)) / sum(case when l_returnflag = 'N' then l_quantity end), 9) as overhead_pct from s group by l_linestatus having count(distinct l_returnflag) = 3""")
_METRIC = lambda e, r: f"count(*) as n, count_if({r} < peak_bytes) as under, round(1000.0 * count_if({r} < peak_bytes) / count(*), 9) as under_per_1000, round(sum({r}) / 1073741824.0, 6) as requested_gib, round(sum({r}) / sum(peak_bytes), 9) as request_ratio, round(sum(greatest({r} - peak_bytes, 0) / 1073741824.0 * coalesce(runtime_seconds, 0) / 3600), 6) as unused_gib_h, round({e.pct(f'abs({r} - peak_bytes) / peak_bytes * 100', 0.5)}, 6) as mdape, round(avg(abs({r} - peak_bytes)), 3) as mae"
_add("ag04_allocation_metrics", lambda e: _REQ + f" select workflow, {_METRIC(e, 'request_a')} from req group by workflow")
_add("ag05_matched_summary", lambda e: _REQ + f""" select workflow, count(*) as n, round(avg(abs(request_a - peak_bytes)) / 1048576.0, 6) as mae_mib, round(100 * avg(abs(request_a - peak_bytes) / peak_bytes), 6) as mape, round({e.pct('abs(request_a - peak_bytes) / peak_bytes', 0.5)}, 6) as median_ape,
 round({e.pct('abs(request_a - peak_bytes) / peak_bytes', 0.95)}, 6) as p95_ape, round(avg(case when request_a < peak_bytes then 1.0 else 0 end), 9) as under_rate, round(sum(request_a) / sum(peak_bytes), 9) as quality, cast(sum(case when request_a >= peak_bytes then 0 else least(20, cast(ceil(round(ln(peak_bytes / request_a) / ln(1.5), 9)) as int)) end) as bigint) as retries,
 round(1 - sum(power(ln(1 + request_a) - ln(1 + peak_bytes), 2)) / (sum(power(ln(1 + peak_bytes), 2)) - power(sum(ln(1 + peak_bytes)), 2) / count(*)), 6) as r2_log from req group by workflow""")
_add("ag06_multi_level_metrics", lambda e: _REQ + f" select workflow, process, {_METRIC(e, 'request_a')} from req group by grouping sets ((), (workflow), (workflow, process))")
_add("ag07_heavy_tail", lambda e: _REQ + f", cut as (select workflow as w, {e.pct('peak_bytes', 0.95)} as p95 from tasks group by workflow) select workflow, {_METRIC(e, 'request_a')} from req join cut on workflow = w where peak_bytes >= p95 group by workflow")
_add("ag08_paired_contrast", _REQ + " select workflow, count_if(request_a < peak_bytes and request_b >= peak_bytes) as rescued, count_if(request_a >= peak_bytes and request_b < peak_bytes) as newly_under, count_if(request_a < peak_bytes and request_b < peak_bytes) as both_under from req group by workflow")
#: The 97.5% quantile of Student's t by degrees of freedom; beyond, its expansion around the normal one.
_T975 = {1: 12.7062, 2: 4.3027, 3: 3.1824, 4: 2.7764, 5: 2.5706, 6: 2.4469, 7: 2.3646, 8: 2.3060, 9: 2.2622}


def student(degrees: str) -> str:
    """SQL of the 97.5% quantile of Student's t; null below one degree of freedom."""
    z = 1.959963984540054
    terms = (z, (z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384, (79 * z**9 + 776 * z**7 + 1482 * z**5 - 1920 * z**3 - 945 * z) / 92160)
    far = " + ".join(f"{t!r}e0 / power({degrees}, {k})" for k, t in enumerate(terms))
    return f"case {degrees} " + " ".join(f"when {k} then {v}" for k, v in _T975.items()) + f" else case when {degrees} > 9 then round({far}, 4) end end"


_add("ag10_repeated_runs", f""", t as (select workflow, count(*) as n, avg(m) as mean, stddev_samp(m) as sd, min(m) as least, max(m) as most, {student("(count(*) - 1)")} as t from (select workflow, task_id % case workflow when 'click' then 5 when 'view' then 12 else 31 end as seed, max(peak_bytes) as m from tasks group by 1, 2) x group by workflow)
 select workflow, n, round(mean, 6) as mean, round(sd, 6) as sd, round(sd / sqrt(n), 6) as sem, round(mean - t * sd / sqrt(n), 4) as low, round(mean + t * sd / sqrt(n), 4) as high, least, most, round(sd / nullif(mean, 0), 9) as cv from t""")
_add("ag11_selection_frequency", "select workflow, process, task_id % 4 as policy, count(*) as n from tasks group by 1, 2, 3")
_add("ag12_linear_quantiles", lambda e: f"select workflow, {e.pct('peak_bytes', 0.5)} as p50, round({e.pct('peak_bytes', 0.95)}, 6) as p95, round({e.pct('peak_bytes', 0.99)}, 6) as p99 from tasks group by workflow")
_add("ag13_nearest_rank_quantiles", lambda e: f"select workflow, {e.disc('peak_bytes', 0.5)} as p50, {e.disc('peak_bytes', 0.95)} as p95 from tasks group by workflow")
_add("ag14_conformal_quantile", """, r as (select workflow, peak_bytes, row_number() over (partition by workflow order by peak_bytes, task_id) as k, count(*) over (partition by workflow) as n from tasks)
 select workflow, max(n) as n, max(case when k = 1 + cast(ceil(least(ceil((n + 1) * 0.95) / n, 1.0) * (n - 1)) as bigint) then peak_bytes end) as q95 from r group by workflow""")
_add("ag15_weighted_quantile", """, c as (select workflow, peak_bytes, sum(input_bytes) over (partition by workflow order by peak_bytes) as cum, sum(input_bytes) over (partition by workflow) as total from tasks)
 select workflow, min(case when cum >= 0.9 * total then peak_bytes end) as q90 from c group by workflow""")
_add("ag16_median_absolute_deviation", lambda e: f", m as (select workflow as w, {e.pct('peak_bytes', 0.5)} as med from tasks group by workflow) select workflow, {e.pct('abs(peak_bytes - med)', 0.5)} as mad from tasks join m on workflow = w group by workflow")
_RANK = lambda by, x: f"(rank() over (partition by {by} order by {x}) + (count(*) over (partition by {by}, {x}) - 1) / 2.0)"
_add("ag17_rank_correlation", f", r as (select workflow, {_RANK('workflow', 'peak_bytes')} as a, {_RANK('workflow', 'input_bytes')} as b from tasks) select workflow, round(corr(a, b), 9) as spearman from r group by workflow")
_add("ag18_classification_scores", f""", s as (select workflow, value / 500.0 as p, case when task_id % 3 = 0 then 1 else 0 end as y from tasks), r as (select *, {_RANK('workflow', 'p')} as rk from s)
 select workflow, round((sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y) * (count(*) - sum(y))), 9) as auc, round(avg(power(p - y, 2)), 9) as brier from r group by workflow""")
_add("ag20_survey_weights", """, s as (select workflow, peak_bytes, 0.1 + (task_id % 9) / 10.0 as pi, abs(peak_bytes - 200000000) / cast(peak_bytes as double) as ape from tasks where task_id % 2 = 0), n as (select workflow as w, count(*) as population from tasks group by workflow),
 c as (select *, least(1 / pi, 5) as clipped, sum(1 / pi) over (partition by workflow order by ape) as upto, sum(1 / pi) over (partition by workflow) as whole from s)
 select workflow, round(sum(1 / pi), 6) as weight, round(sum(clipped), 6) as clipped_weight, round(power(sum(1 / pi), 2) / sum(1 / pi / pi), 6) as effective_n, round(power(sum(clipped), 2) / sum(clipped * clipped), 6) as clipped_n, round(sum(peak_bytes / pi) / max(population), 3) as total_mean, round(sum(peak_bytes / pi) / sum(1 / pi), 3) as mean_peak,
 round(min(case when upto >= 0.5 * whole then ape end), 9) as median_ape, round(min(case when upto >= 0.95 * whole then ape end), 9) as p95_ape from c join n on workflow = w group by workflow""")
_add("ag21_selection_yield", _REQ + """, s as (select *, task_id % 4 as policy, task_id % 5 = 0 as chosen, peak_bytes > request_a as target, greatest(peak_bytes - request_a, 0) as shortfall from req)
 select workflow, policy, count_if(chosen) as chosen_tasks, round(count_if(chosen and target) / nullif(cast(count_if(target) as double), 0), 9) as recall, round(count_if(chosen and target) / nullif(cast(count_if(chosen) as double), 0), 9) as precision_,
 round(sum(case when chosen then shortfall else 0 end) / nullif(sum(shortfall), 0), 9) as shortfall_share, round(count(distinct case when chosen then process end) / cast(count(distinct process) as double), 9) as process_coverage, round(100 * (sum(case when chosen then request_b else request_a end) - sum(request_a)) / sum(request_a), 6) as request_change_pct from s group by 1, 2""")
_add("ag24_attempts_to_tasks", """, t as (select conv_id, turn, role, length(text) as size, case when role = 'assistant' then 1 else 0 end as ok from @conversations), g as (select conv_id, turn, max(size) as size, max(ok) as ok from t group by 1, 2),
 r as (select *, row_number() over (partition by conv_id order by turn) as up, row_number() over (partition by conv_id order by ok desc, turn desc) as down from g)
 select conv_id, max(case when up = 1 then size end) as first_size, max(case when down = 1 then size end) as final_size, count(*) as attempts from r group by conv_id""")
_add("ag25_group_inventory", "select workflow, process, task_instance, count(*) as n from tasks group by grouping sets ((), (workflow), (workflow, process), (workflow, process, task_instance))")
_add("ag27_operating_points", lambda e: _REQ + f""", f as (select workflow, sum(request_b) / sum(request_a) as budget_factor, {e.disc('peak_bytes / request_a', 0.95)} as coverage_factor from req group by workflow)
 select r.workflow, round(max(budget_factor), 9) as equal_budget_factor, max(coverage_factor) as coverage_factor, count_if(round(request_a * budget_factor, 3) < peak_bytes) as under_at_budget, count_if(round(request_a * coverage_factor, 3) < peak_bytes) as under_at_coverage, round(sum(request_a * coverage_factor) / 1073741824.0, 6) as gib_at_coverage from req r join f on r.workflow = f.workflow group by r.workflow""")
_add("ag28_matched_scaling", _REQ + ", s as (select *, task_id % 5 as batch from req) select task_id, round(request_a * sum(request_b) over (partition by batch) / sum(request_a) over (partition by batch), 3) as scaled from s")

# Windows, ranking, top-k.
_add("wn01_ranks_and_tops", """, r as (select task_id, row_number() over (partition by workflow order by peak_bytes desc, task_id) as peak_rank, row_number() over (partition by workflow order by coalesce(consumed_bytes, -1) desc, task_id) as consumed_rank, count(*) over (partition by workflow) as n from tasks)
 select task_id, peak_rank, consumed_rank, """ + ", ".join(f"{m}_rank <= greatest(1, ceil(n * {t / 100})) as {m}_top{t}" for m in ("peak", "consumed") for t in (1, 5, 10)) + " from r")
_add("wn02_percent_rank", f"select task_id, {_RANK('workflow', 'input_bytes')} / count(*) over (partition by workflow) as pct from tasks")
_add("wn08_midpoint_split", """, c as (select workflow, input_identity, count(*) as size, min(decision_us) as t from tasks group by 1, 2), m as (select *, (sum(size) over (partition by workflow order by t, input_identity) - size / 2.0) / sum(size) over (partition by workflow) as mid from c)
 select workflow, input_identity, case when mid <= 0.70 then 'train' when mid <= 0.85 then 'calibration' else 'test' end as role from m""")
# A quota of each stratum: at least one, at most its size; the remainder goes to the largest fractions with room.
_add("wn09_largest_remainder", """, s as (select workflow, process, count(*) as size from tasks group by 1, 2), q as (select *, 1 + (100.0 - count(*) over ()) * (size - 1) / sum(size - 1) over () as raw from s),
 f as (select *, least(floor(raw), size) as base, case when floor(raw) < size then raw - floor(raw) else -1 end as rest from q), r as (select *, row_number() over (order by rest desc, workflow, process) as r, 100 - sum(base) over () as spare from f)
 select workflow, process, size, cast(base + case when r <= spare and rest >= 0 then 1 else 0 end as bigint) as quota from r""")
_add("wn10_round_robin_folds", lambda e: f", g as (select distinct workflow, task_instance from tasks) select workflow, task_instance, (row_number() over (partition by workflow order by {e.sha('task_instance')}, task_instance) - 1) % 5 as fold from g")
_add("wn12_even_batches", "select task_id, ntile(5) over (partition by workflow, process order by decision_us, task_id) as batch from tasks")
_add("wn13_audit_plan", "select workflow, task_id, r from (select workflow, task_id, row_number() over (partition by workflow order by peak_bytes desc, task_id) as r, count(*) over (partition by workflow) as n from tasks) t where r <= ceil(n * 0.2)")
_add("wn14_holm", """, p as (select workflow, process, 1.0 / (1 + count(*)) as p from tasks group by 1, 2), r as (select *, row_number() over (order by p, workflow, process) as k, count(*) over () as n from p)
 select workflow, process, round(max(least((n - k + 1) * p, 1)) over (order by k), 12) as adjusted from r""")

# Splits, sampling, checks.
_add("sp01_cohort_filter", "select task_id from (select task_id, runtime_seconds, count(*) over (partition by workflow, process) as n from tasks where runtime_seconds > 0) t where n >= 34")
_add("sp02_hash_split", lambda e: f"select task_id, case when row_number() over (partition by workflow, process order by {e.sha('cast(task_id as string)')}) <= floor(0.3 * count(*) over (partition by workflow, process)) then 'train' else 'test' end as role from tasks")
_add("sp04_leave_one_out", ", f as (select workflow as fold, row_number() over (order by workflow) as i, count(*) over () as n from (select distinct workflow from tasks) d) select f.fold, t.workflow, case when t.workflow = f.fold then 'test' when g.i = f.i % f.n + 1 then 'calibration' else 'train' end as role, count(*) as n from tasks t cross join f join f g on g.fold = t.workflow group by 1, 2, 3")
_add("sp06_inclusion_probability", lambda e: f"select task_id, row_number() over (partition by workflow order by {e.sha('cast(task_id as string)')}) <= 20 as audited, least(20.0 / count(*) over (partition by workflow), 1) as inclusion from tasks")
_add("dq02_keys_and_measures", "select count(*) as n, count(distinct task_id) as ids, count_if(peak_bytes <= 0) as not_positive, count_if(consumed_bytes is null) as missing from tasks")
_add("dq04_measure_identity", """, w as (select workflow, process, sum(coalesce(consumed_bytes, 0)) as consumed, sum(input_bytes) as input from tasks group by 1, 2), p as (select workflow, process, sum(coalesce(consumed_bytes, 0) + input_bytes) as together, sum(coalesce(consumed_bytes, 0) + case when task_id % 100 = 0 then input_bytes + 1 else input_bytes end) as drifted from tasks group by 1, 2)
 select w.workflow, count_if(abs(consumed + input - together) > 0.5) as differing, count_if(abs(consumed + input - drifted) > 0.5) as differing_after_drift from w join p on w.workflow = p.workflow and w.process = p.process group by w.workflow""")
_add("dq07_identity_overlap", "select input_identity, count(distinct process) as roles from tasks group by input_identity having count(distinct process) > 1")
_add("dq08_temporal_violations", "select count_if(l_shipdate < o_orderdate) as shipped_before_order, count(*) as n from @lineitem join @orders on l_orderkey = o_orderkey", False)
_add("dq11_golden_comparison", """, g as (select workflow as w, process as p, avg(peak_bytes) as golden from tasks where not (workflow = (select min(workflow) from tasks) and process = 'p0') group by 1, 2), h as (select workflow, process, sum(peak_bytes) / cast(count(*) as double) * case when process = 'p1' then 1.001 else 1 end as now from tasks where process <> 'p2' or task_id % 2 = 0 group by 1, 2)
 select coalesce(workflow, w) as workflow, coalesce(process, p) as process, case when golden is null then 'added' when now is null then 'missing' when abs(now - golden) <= 0.000000001 * abs(golden) then 'equal' else 'different' end as verdict from h full outer join g on workflow = w and process = p""")

# Policies.
_add("md08_base_bound", "select task_id, greatest(value, case task_id % 3 when 0 then value * 1.1 when 1 then value * 0.9 else value * 1.5 end) as bound from tasks")
_add("md09_log_residual", _REQ + " select task_id, round(ln(peak_bytes / request_a), 9) as residual from req")
# Seven bases and six residual quantiles: bases and residuals from development tasks, coverage on the held-out fifth.
_BASES = {"point_q50": 0.5, "model_q75": 0.75, "model_q90": 0.9, "model_q95": 0.95, "model_q99": 0.99, "model_q995": 0.995, "most": 1.0}
_TAILS = (0.5, 0.75, 0.9, 0.95, 0.99, 0.995)
_add("md11_candidate_grid", lambda e: f""", d as (select workflow, process, {", ".join(f"{e.pct('peak_bytes', q)} as {n}" for n, q in _BASES.items())} from tasks where task_id % 5 <> 0 group by 1, 2),
 l as (select task_id, workflow, peak_bytes, base, bound from (select t.task_id, t.workflow, t.peak_bytes, d.* {"except" if e.spark else "exclude"} (workflow, process) from tasks t join d on t.workflow = d.workflow and t.process = d.process) t {"unpivot (bound for base in (" + ", ".join(_BASES) + "))" if e.spark else "unpivot (bound for base in (" + ", ".join(_BASES) + "))"}),
 r as (select workflow, base, {", ".join(f"greatest(ln({e.pct('peak_bytes / bound', q)}), 0) as k{i}" for i, q in enumerate(_TAILS))} from l where task_id % 5 <> 0 group by 1, 2),
 g as ({" union all ".join(f"select l.workflow, l.base, {q} as tail, peak_bytes, ceil(round(bound * exp(k{i}) / 1048576, 6)) * 1048576 as request from l join r on l.workflow = r.workflow and l.base = r.base where task_id % 5 = 0" for i, q in enumerate(_TAILS))}),
 w as (select base, tail, workflow, avg(case when request >= peak_bytes then 1.0 else 0 end) as coverage, count(*) as n, sum(request) as asked, sum(peak_bytes) as used, count_if(request < peak_bytes) as under from g group by 1, 2, 3)
 select base, tail, cast(sum(n) as bigint) as tasks, round(sum(coverage * n) / sum(n), 9) as coverage, round(min(coverage), 9) as least_coverage, round(sum(asked) / sum(used), 6) as ratio, cast(sum(under) as bigint) as under from w group by base, tail""")
_add("md15_retry_ladder", lambda e: _REQ + f""", h as (select workflow as w, {e.pct('peak_bytes', 0.99)} as p99 from tasks group by workflow), r as (select *, case when request_a >= peak_bytes then 0 else least(20, cast(ceil(round(ln(peak_bytes / request_a) / ln(1.5), 9)) as int)) end as steps from req join h on workflow = w)
 select task_id, steps as retries, case when request_a >= peak_bytes then 0 when greatest(p99, request_a * 1.5) >= peak_bytes then 1 else 1 + least(19, cast(ceil(round(ln(peak_bytes / greatest(p99, request_a * 1.5)) / ln(1.5), 9)) as int)) end as history_retries from r""")
_add("st10_retry_floor", "select task_id, coalesce(lag(peak_bytes) over (partition by task_instance, process order by decision_us, task_id) * 1.5, 0) as least_request from tasks")
