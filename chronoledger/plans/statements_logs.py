"""Further plain statements: log lines, matching, aggregations and windows."""

from __future__ import annotations

from ..functions import rules
from .statements import _RANK, _REQ, _add

#: Process names as pipelines print them, one for each number.
_NAMES = ("NF:KRAKEN2_RUN", "prep:UNTAR", "gatk:MERGE_HAPLOTYPECALLER", "gatk:HAPLOTYPECALLER", "map:BUILD_INDEX", "map:bwamem align", "SAMTOOLS:FLAGSTAT", "qc:fastqc", "qc:FASTP", "qc:MOSDEPTH", "report:krona", "TABIX:bgzip", "main:SORT_SORT", "main:custom-step", "data:download_reads", "x:scatter intervals", "y:generate", "z:A_A_A", "w:STAR GENOME INDEX)", "v:", "_", " :  (sort-sort) ", "u:Öffnen 2", "t:MAKE_INDEX_FILE", "index")
_NAMED = ", named as (select task_id, case task_id % " + str(len(_NAMES)) + " " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(_NAMES)) + " end as name from tasks)"
_PATHS = ", paths as (select task_id, input_bytes, case task_id % 7 when 0 then '/runs/a1/work/stage-7/x.bam' when 1 then '/runs/a1/work/3f/out.bam' when 2 then 's3://bucket/reads.fq' when 3 then 'https://host/ref.fa' when 4 then '/work/stage-2/in.vcf' when 5 then '/workflow/data/panel.bed' else '/tmp/other.txt' end as path from tasks)"

# Parsing.
_add("fn07_timestamp_parse", lambda e: f""", raw as (select task_id, case task_id % 3 when 0 then '2024-03-0' || cast(task_id % 9 + 1 as string) || 'T10:00:0' || cast(task_id % 10 as string) || 'Z' when 1 then '2024-03-0' || cast(task_id % 9 + 1 as string) || ' 11:30:00' else 'unknown' end as v from tasks)
 select task_id, {"unix_micros(cast(try_cast(replace(v, 'Z', '') as timestamp_ntz) as timestamp))" if e.spark else "epoch_us(try_cast(replace(v, 'Z', '') as timestamp))"} as us from raw""")
_add("fn09_lifecycle_minutes", """, lines as (select workflow, cast(decision_us as string) || case when task_id % 50 = 0 then ' Execution complete' else ' Submitted process' end as line from tasks),
 s as (select workflow, line, cast(regexp_extract(line, '^([0-9]+)', 1) as bigint) as us from lines) select workflow, round((max(case when line like '%Execution complete' then us end) - min(us)) / 60000000.0, 6) as minutes from s group by workflow""")
_add("fn16_operation_rules", lambda e: _NAMED + f""" select task_id, {rules.first('upper(name)', rules.OPERATIONS, lambda r: f"'{r[1]}'", rules.terminal('name', e), e.like)} as operation,
 {rules.first('upper(name)', rules.OPERATIONS, lambda r: "'" + '|'.join(sorted(r[2])) + "'", "'" + '|'.join(rules.UNCLASSIFIED) + "'", e.like)} as classes from named""")
_add("fn17_process_family", lambda e: _NAMED + f""", w as (select task_id, {rules.underscored('name', e)} as v from named) select task_id, {rules.first('v', rules.FAMILIES, lambda r: f"'{r[1]}'", "'other'", e.like)} as family from w""")
_add("fn19_source_class", lambda e: _PATHS + f""" select task_id, {rules.first('path', rules.SOURCES, lambda r: f"'{r[1]}'", "'external'", e.like)} as source_class from paths""")
_add("fn23_retry_group", """, raw as (select task_id, process, task_instance, case when task_id % 2 = 0 then 'run_err' || task_instance || '_a' else 'other' end as tag from tasks)
 select task_id, coalesce(nullif(regexp_extract(upper(tag), '(ERR[0-9]+)', 1), ''), process || '::' || task_instance) as retry_group from raw""")
_add("fn24_array_literal", """, raw as (select task_id, '[' || cast(value as string) || ', ' || cast(value * 2 as string) || ', ' || cast(value * 4 as string) || ']' as v from tasks)
 select task_id, cast(regexp_extract(v, '^.([0-9.]+)', 1) as double) as first_value, cast(regexp_extract(v, '([0-9.]+).$', 1) as double) as last_value from raw""")

# Log lines and traces.
_LINES = """, lines as (select workflow, task_instance, case task_id % 6 when 0 then 'read(3, "x", 4096) = ' || cast(task_id % 4096 as string) when 1 then '[pid 7] write(1, "y", 10) = ' || cast(task_id % 512 as string) when 2 then 'read(3,  <unfinished ...>'
  when 3 then '<... read resumed>"z", 64) = ' || cast(task_id % 64 as string) when 4 then 'mmap(NULL, 4096, PROT_READ) = 0x7f00' else 'pread64(3, "", 8) = -1 EAGAIN' end as line from tasks),
 c as (select *, line like '%<unfinished%' as open_half, regexp_extract(line, '(read|pread64|readv|write|pwrite64|mmap)( resumed>|[(])', 1) as call, coalesce(try_cast(nullif(regexp_extract(line, '= (-?[0-9]+)( |$)', 1), '') as bigint), 0) as ret from lines)"""
_add("log01_syscall_summary", _LINES + """ select workflow, task_instance, count_if(call in ('read', 'pread64', 'readv') and not open_half) as read_calls, cast(sum(case when call in ('read', 'pread64', 'readv') and not open_half then greatest(ret, 0) else 0 end) as bigint) as read_bytes,
 count_if(call in ('write', 'pwrite64') and not open_half) as write_calls, cast(sum(case when call in ('write', 'pwrite64') and not open_half then greatest(ret, 0) else 0 end) as bigint) as write_bytes, count_if(call = 'mmap' and not open_half) as mmap_calls from c group by workflow, task_instance""")
_add("log02_successful_only", lambda e: f""", l as (select task_id, {e.sha('cast(task_id as string)')} as h from tasks), ok as (select distinct substr({e.sha('cast(task_id as string)')}, 1, 8) as p from tasks where runtime_seconds is not null) select task_id from l where exists (select 1 from ok where p = substr(h, 1, 8))""")
_add("log03_attribution_by_task", "select workflow, task_instance, cast(sum(consumed_bytes) as bigint) as read_bytes, cast(sum(input_bytes) as bigint) as mmap_bytes, round(100.0 * sum(input_bytes) / nullif(sum(coalesce(consumed_bytes, 0) + input_bytes), 0), 9) as mmap_pct from tasks group by workflow, task_instance")
_add("log04_attribution_by_file", "select input_identity as filename, cast(sum(coalesce(consumed_bytes, 0) + input_bytes) as bigint) as total from tasks group by input_identity order by total desc, filename")
_add("log05_staged_links", lambda e: _PATHS + f""", l as (select task_id, {e.steps('0', 'cast(task_id % 3 as int)')} as link from tasks), c as (select l.task_id, link, p.input_bytes, {rules.first('p.path', rules.SOURCES, lambda r: f"'{r[1]}'", "'external'", e.like)} as kind from l join paths p on p.task_id = l.task_id - l.task_id % 7 + (l.task_id + l.link) % 7)
 select task_id, cast(sum(case when kind = 'original' then input_bytes else 0 end) as bigint) as original_bytes, cast(sum(case when kind = 'intermediate' then input_bytes else 0 end) as bigint) as intermediate_bytes, cast(sum(case when kind = 'external' then input_bytes else 0 end) as bigint) as external_bytes,
 {"listagg(kind, '|') within group (order by link)" if e.spark else "string_agg(kind, '|' order by link)"} as kinds from c group by task_id""")
_add("log06_trace_rows", """, t as (select task_id, case task_id % 4 when 0 then 'FAILED' when 1 then 'CACHED' else 'COMPLETED' end as status, case when task_id % 5 = 0 then '-' else cast(task_id % 90 as string) || '.5 MB' end as read_bytes, cast(task_id % 30 as string) || ' MB' as rchar from tasks)
 select task_id, cast(round(coalesce(try_cast(nullif(regexp_extract(read_bytes, '^([0-9.]+)', 1), '') as double), try_cast(regexp_extract(rchar, '^([0-9.]+)', 1) as double)) * 1048576) as bigint) as bytes from t where status in ('COMPLETED', 'CACHED')""")

# Joins and matching.
_add("jn02_features_back", "select o_orderkey, n, quantity from @orders left join (select l_orderkey, count(*) as n, sum(l_quantity) as quantity from @lineitem group by l_orderkey) l on o_orderkey = l_orderkey", False)
_add("jn04_exact_else_prefix", lambda e: f""", h as (select task_id, {e.sha('cast(task_id as string)')} as h from tasks), trace as (select task_id as trace_id, h as full_hash, substr(h, 1, 8) as p from h where task_id % 2 = 0)
 select h.task_id, coalesce(a.trace_id, b.trace_id) as trace_id from h left join trace a on a.full_hash = h.h and h.task_id % 4 = 0 left join (select p, min(trace_id) as trace_id from trace group by p having count(*) = 1) b on b.p = substr(h.h, 1, 8)""")
_add("jn06_cascaded_assignment", """, u as (select process, task_instance as unit, task_id as uid from (select *, row_number() over (partition by process, task_instance order by task_id) as k from tasks) x where k = 1 and task_id % 2 = 0),
 i as (select process, case when task_id % 3 = 0 then task_instance else 'run_' || task_instance || '_x' end as instance, task_id as iid from (select *, row_number() over (partition by process, task_instance order by task_id desc) as k from tasks) y where k = 1 and task_id % 5 <> 0),
 s1 as (select u.uid, i.iid from u join i on u.process = i.process and u.unit = i.instance),
 u2 as (select * from u where uid not in (select uid from s1)), i2 as (select * from i where iid not in (select iid from s1)),
 m2 as (select u2.uid, i2.iid, count(*) over (partition by u2.uid) as a, count(*) over (partition by i2.iid) as b from u2 join i2 on u2.process = i2.process and i2.instance = 'run_' || u2.unit || '_x'), s2 as (select uid, iid from m2 where a = 1 and b = 1),
 u3 as (select *, row_number() over (partition by process order by unit, uid) as k, count(*) over (partition by process) as n from u2 where uid not in (select uid from s2)),
 i3 as (select *, row_number() over (partition by process order by instance, iid) as k, count(*) over (partition by process) as n from i2 where iid not in (select iid from s2)),
 s3 as (select u3.uid, i3.iid from u3 join i3 on u3.process = i3.process and u3.k = i3.k and u3.n = i3.n)
 select uid, iid, 1 as stage from s1 union all select uid, iid, 2 from s2 union all select uid, iid, 3 from s3""")
_add("jn09_dictionary_lookup", "select s_suppkey, n_name, r_name from @supplier left join @nation on s_nationkey = n_nationkey left join @region on n_regionkey = r_regionkey", False)

# Aggregations.
_EDGES = lambda e: ", ".join(f"{e.pct('p', i / 10)} as e{i}" for i in range(11))
_BIN = " + ".join(f"case when p > e{i} and e{i} > e{i - 1} then 1 else 0 end" for i in range(1, 10))
_add("ag19_reliability_bins", lambda e: f""", s as (select workflow, value / 500.0 as p, case when task_id % 3 = 0 then 1 else 0 end as y from tasks), g as (select workflow as w, {_EDGES(e)} from s group by workflow)
 select workflow, {_BIN} as bin, count(*) as n, round(avg(p), 9) as mean_p, round(avg(y), 9) as observed from s join g on workflow = w group by 1, 2""")
_add("ag22_repetition_summary", lambda e: f"select workflow, policy, round(avg(m), 6) as mean, round(stddev_samp(m), 6) as sd, {e.pct('m', 0.5)} as med, round({e.pct('m', 0.025)}, 6) as low, round({e.pct('m', 0.975)}, 6) as high from (select workflow, task_id % 3 as policy, task_id % 20 as rep, max(peak_bytes) as m from tasks group by 1, 2, 3) t group by workflow, policy")
_add("ag23_live_metrics", lambda e: f"select process, count(*) as n, count(consumed_bytes) as measured, round(avg(runtime_seconds), 6) as runtime, {e.pct('runtime_seconds', 0.5)} as median_runtime, round(sum(peak_bytes * runtime_seconds) / nullif(sum(runtime_seconds), 0), 3) as weighted_peak from tasks group by grouping sets ((process), ())")
_add("ag26_budget_accounting", _REQ + """, c as (select task_id % 5 as seed, b.budget, sum(case when task_id % 10 < b.budget then greatest(request_b - request_a, 0) / 1073741824.0 else 0 end) as saved, sum(case when task_id % 10 < b.budget then coalesce(runtime_seconds, 0) / 3600 else 0 end) as cost
  from req cross join (select 1 as budget union all select 2 union all select 5) b group by 1, 2) select budget, round(avg(saved), 6) as saved, round(avg(cost), 6) as cost, round(avg(saved - cost), 6) as net from c group by budget""")
_add("ag29_empirical_multiplier", _REQ + """, r as (select workflow, peak_bytes / request_a as f, row_number() over (partition by workflow order by peak_bytes / request_a, task_id) as k, count(*) over (partition by workflow) as n from req)
 select workflow, round(greatest(max(case when k = 1 + cast(ceil(0.95 * (n - 1)) as bigint) then f end), 1), 9) as multiplier from r group by workflow""")
_add("ag17_pinball_loss", _REQ + " select workflow, round(avg(greatest(0.99 * (peak_bytes - request_a), -0.01 * (peak_bytes - request_a))), 3) as pinball99, round(avg(case when peak_bytes <= request_a then 1.0 else 0 end), 9) as coverage from req group by workflow")
_add("ag18_average_precision", """, s as (select workflow, value as p, case when task_id % 3 = 0 then 1 else 0 end as y from tasks), t as (select workflow, p, sum(y) as pos, count(*) as n from s group by 1, 2),
 c as (select workflow, pos, sum(pos) over w as tp, sum(n) over w as seen, sum(pos) over (partition by workflow) as total from t window w as (partition by workflow order by p desc)) select workflow, round(sum(pos * tp / cast(seen as double)) / max(total), 9) as average_precision from c group by workflow""")

# Tasks that one of two requests covers and the other does not; the binomial tail at 1/2, as sums of logarithms.
_add("ag09_mcnemar", lambda e: _REQ + f""", d as (select workflow, count_if(request_a < peak_bytes and request_b >= peak_bytes) as rescued, count_if(request_a >= peak_bytes and request_b < peak_bytes) as broken from req group by workflow),
 i as (select workflow, rescued, broken, rescued + broken as n, {e.steps('0', 'cast(least(rescued, broken) as int)')} as i from d),
 l as (select *, coalesce(sum(case when i > 0 then ln((n - i + 1) / cast(i as double)) end) over (partition by workflow order by i), 0) as log_ways from i)
 select workflow, rescued, broken, round(least(2 * sum(exp(log_ways - n * ln(2))), 1), 9) as p_value from l group by workflow, rescued, broken""")

# Windows.
_add("wn05_leave_one_out", """, r as (select task_id, workflow, process, peak_bytes, row_number() over (partition by workflow, process order by decision_us desc, task_id desc) as k from tasks),
 s as (select workflow as w, process as p, sum(case when k <= 512 then peak_bytes end) as tail, sum(case when k <= 513 then peak_bytes end) as tail1, count(*) as n from r group by 1, 2)
 select task_id, least(n - 1, 512) as support, round(case when k > 512 then tail / 512.0 when n > 1 then (tail1 - peak_bytes) / cast(least(n - 1, 512) as double) end, 3) as mean_peak from r join s on workflow = w and process = p""")
_add("wn11_hash_role_cut", lambda e: f", g as (select distinct workflow, task_instance from tasks), r as (select *, row_number() over (partition by workflow order by {e.sha('task_instance')}) as k, count(*) over (partition by workflow) as n from g) select workflow, task_instance, case when k <= 0.6 * n then 'train' when k <= 0.8 * n then 'calibration' else 'test' end as role from r")
_add("wn02_ties_by_process", f"select task_id, round({_RANK('process', 'input_bytes')} / count(*) over (partition by process), 12) as pct from tasks")
