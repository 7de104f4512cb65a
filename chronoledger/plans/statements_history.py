"""Further plain statements: history scopes, splits, selection, policies, feedback and checks."""

from __future__ import annotations

from .statements import _RANK, _REQ, _add

# History scopes.
_add("hs01_hierarchy_keys", """, k as (select 'I0' as scope, workflow || '|' || process || '|' || task_instance as key from tasks union all select 'I1', input_identity from tasks union all select 'I3', workflow || '|' || process from tasks union all select 'I4', workflow from tasks union all select 'I5', 'all' from tasks)
 select scope, key, count(*) as n from k where key is not null group by scope, key""")
_add("hs12_partial_labels", lambda e: f", m as (select workflow, peak_bytes, case when task_id % 5 = 0 then consumed_bytes end as seen from tasks) select workflow, count(*) as n, count(seen) as audited, round({e.pct('seen', 0.95)}, 3) as consumed_p95, round({e.pct('peak_bytes', 0.95)}, 3) as peak_p95 from m group by workflow")
_add("hs13_outcome_upsert", """, w as (select task_id % 5000 as id, peak_bytes, completion_us, task_id as seq from tasks), r as (select *, row_number() over (partition by id order by completion_us desc, seq desc) as k from w) select id, peak_bytes, completion_us from r where k = 1""")
_add("hs14_snapshot_counts", """, base as (select task_id as id, completion_us from tasks where task_id % 3 <> 0), run as (select task_id as id, completion_us from tasks where task_id % 2 = 0)
 select count(*) as next_rows, count_if(b and r) as replaced, count_if(b and not r) as kept, count_if(r and not b) as added from (select id, max(b) as b, max(r) as r from (select id, true as b, false as r from base union all select id, false, true from run) u group by id) s""")
_add("hs15_global_only", lambda e: f", tail as (select peak_bytes from tasks order by completion_us desc, task_id desc limit 512), g as (select count(*) as support, {e.pct('peak_bytes', 0.5)} as p50, round({e.pct('peak_bytes', 0.95)}, 3) as p95 from tail) select task_id, support, p50, p95 from tasks cross join g")
_add("hs16_signal_swap", lambda e: f"select workflow, {e.pct('consumed_bytes', 0.5)} as read_only, {e.pct('consumed_bytes + input_bytes', 0.5)} as read_mmap from tasks group by workflow")

# Splits, lanes and draws.
_add("sp03_role_remap", lambda e: f", r as (select task_id, workflow, decision_us, case when {e.hex_to_int('substr(' + e.sha('cast(task_id as string)') + ', 1, 2)')} < 154 then 'train' when {e.hex_to_int('substr(' + e.sha('cast(task_id as string)') + ', 1, 2)')} < 205 then 'calibration' else 'test' end as role from tasks) select task_id, case when role = 'test' then 'test' else 'train' end as role, row_number() over (partition by workflow order by case when role = 'test' then 1 else 0 end, decision_us, task_id) as position from r")
_add("sp07_random_comparators", lambda e: f", r as (select task_id, row_number() over (partition by workflow, process order by {e.sha("'1|' || cast(task_id as string)")}) as k, count(*) over (partition by workflow, process) as n from tasks) select task_id, ceil(0.2 * n) / n as inclusion from r where k <= ceil(0.2 * n)")
# Audits of the riskiest are the same in every repetition: only what is drawn is multiplied, and ordered once for all budgets.
_BUDGETS = (5, 10, 20, 30, 50, 100)
_TOP, _ALL = "risk <= ceil(n * {b} / 200.0)", "ceil(n * {b} / 100.0)"
_DRAWN = "k <= ceil(n * {b} / 100.0)"
_MIXED = "(" + _TOP + " or k - j{b} <= ceil(n * {b} / 100.0) - ceil(n * {b} / 200.0))"
_add("sp08_repeated_policies", lambda e: f""", t as (select task_id, workflow, peak_bytes, row_number() over (partition by workflow order by value desc, task_id) as risk, count(*) over (partition by workflow) as n from tasks),
 x as (select task_id, workflow, peak_bytes, n, risk, {e.steps('0', '999')} as rep from t), u as (select *, {e.hex_to_int('substr(' + e.sha("cast(rep as string) || '|' || cast(task_id as string)") + ', 1, 13)')} as u from x),
 r as (select rep, workflow, peak_bytes, n, risk, row_number() over (partition by rep, workflow order by u, task_id) as k, {", ".join(f"count_if({_TOP.format(b=b)}) over (partition by rep, workflow order by u, task_id rows between unbounded preceding and current row) as j{b}" for b in _BUDGETS)} from u),
 g as (select rep, workflow, {", ".join(f"count_if({c.format(b=b)}) as {m}_n{b}, cast(sum(case when {c.format(b=b)} then peak_bytes else 0 end) as bigint) as {m}_b{b}" for b in _BUDGETS for m, c in (("random", _DRAWN), ("mixed", _MIXED)))} from r group by rep, workflow),
 d as (select workflow, {", ".join(f"count_if(risk <= {_ALL.format(b=b)}) as n{b}, cast(sum(case when risk <= {_ALL.format(b=b)} then peak_bytes else 0 end) as bigint) as b{b}" for b in _BUDGETS)} from t group by workflow),
 a as (select g.*, {", ".join(f"d.n{b} as risk_n{b}, d.b{b} as risk_b{b}" for b in _BUDGETS)} from g join d on g.workflow = d.workflow)
 select rep, workflow, {e.rows([dict(budget=b, policy=f"'{m}'", audited=f"{m}_n{b}", bytes=f"{m}_b{b}") for b in _BUDGETS for m in ("random", "mixed", "risk")])} from a""")
_add("sp11_seed_means", lambda e: f""", m as (select task_id % 5 as seed, avg(peak_bytes / 1048576.0) as mean from tasks group by 1), x as (select {e.steps('0', '9999')} as rep), d as (select rep, {e.steps('0', '4')} as draw from x),
 p as (select rep, {e.hex_to_int('substr(' + e.sha("cast(rep as string) || '|' || cast(draw as string)") + ', 1, 12)')} % 5 as seed from d), g as (select rep, avg(mean) as mean from p join m on p.seed = m.seed group by rep)
 select count(*) as reps, round({e.pct('mean', 0.025)}, 6) as low, round({e.pct('mean', 0.975)}, 6) as high from g""")
_add("sp12_capped_sample", lambda e: f"select workflow, task_id from (select workflow, task_id, row_number() over (partition by workflow order by {e.sha('cast(task_id as string)')}) as k from tasks) t where k <= 10")

# Policies.
_add("md16_prediction_table", _REQ + " select task_id, workflow, process, 'history' as method, round(request_a, 3) as point, round(greatest(request_a, request_b), 3) as bound, peak_bytes, request_a < peak_bytes as underallocated, runtime_seconds from req")
_add("md22_route_comparison", _REQ + ", l as (select workflow, peak_bytes, 'global' as route, request_a as request from req union all select workflow, peak_bytes, 'process', request_b from req union all select workflow, peak_bytes, 'mixed', greatest(request_a, request_b) from req) select route, workflow, count_if(request < peak_bytes) as under, round(sum(request) / sum(peak_bytes), 9) as ratio from l group by grouping sets ((route), (route, workflow))")
_add("md23_cold_warm_route", "select task_id, case when k.workflow is null then 'cold' else 'warm' end as route from tasks t left join (select workflow from tasks group by workflow having count(*) % 2 = 0) k on t.workflow = k.workflow")

# Feedback.
_OUT = ", o as (select *, case when task_id % 17 = 0 then 137 when task_id % 13 = 0 then 1 else 0 end as exit_code from tasks)"
_add("st03_eligibility_route", _OUT + " select task_id, case when exit_code = 0 and consumed_bytes is not null then 'training' when exit_code in (0, 137) then 'history' else 'skipped' end as route from o")
_add("st05_gap_stopping", ", s as (select workflow, row_number() over (partition by workflow order by completion_us, task_id) as seq, task_id from tasks), a as (select * from s where task_id % 97 <> 0), g as (select *, seq - row_number() over (partition by workflow order by seq) as gap from a) select workflow, count(*) as applied, max(seq) as up_to from g where gap = 0 group by workflow")
_add("st07_calibration_block", "select task_id, case when row_number() over (partition by workflow order by completion_us desc, task_id desc) <= 128 then 'calibration' else 'fit' end as block from tasks")
_add("st09_versions_agree", ", m as (select workflow, max(task_id) % 3 as version from tasks group by workflow), c as (select workflow, max(case when consumed_bytes is not null then task_id end) % 3 as version from tasks group by workflow) select m.workflow, m.version = c.version as agree from m left join c on m.workflow = c.workflow")

# Checks.
_add("dq03_population", ", x as (select workflow, process, count(*) as expected from tasks group by 1, 2), f as (select workflow, process, count(*) as found from tasks where consumed_bytes is not null group by 1, 2) select x.workflow, x.process, expected, coalesce(found, 0) as found, round(coalesce(found, 0) / cast(expected as double), 9) as coverage from x left join f on x.workflow = f.workflow and x.process = f.process")
_add("dq05_version_difference", "select workflow, process from (select workflow, process from tasks where task_id % 2 = 0) a except select workflow, process from tasks where consumed_bytes is null union all select 'checked' as workflow, cast(count(*) as string) as process from tasks")
_add("dq09_split_fraction_error", lambda e: f", r as (select workflow, {e.hex_to_int('substr(' + e.sha('cast(task_id as string)') + ', 1, 2)')} < 179 as train from tasks) select workflow, round(abs(count_if(train) / cast(count(*) as double) - 0.7), 9) as error from r group by workflow")
_add("dq10_check_report", """, c as (select count(*) as n, count(distinct task_id) as ids, count_if(peak_bytes <= 0) as bad, count_if(completion_us < decision_us) as early from tasks)
 select 'unique_ids' as name, cast(n - ids as bigint) as found, case when n = ids then 'PASS' else 'FAIL' end as status from c union all select 'positive_peaks', bad, case when bad = 0 then 'PASS' else 'FAIL' end from c union all select 'time_order', early, case when early = 0 then 'PASS' else 'FAIL' end from c""")

# Running sums over long orders: totals of each hour are carried on, and rows are ordered inside their hour only, so no
# task gets more than an hour of one key.
_HOUR = "cast(floor({} / 3600000000.0) as bigint)"
_add("wn03_total_order", f""", b as (select task_id, workflow, process, decision_us, {_HOUR.format('decision_us')} as slot from tasks),
 n as (select slot, cast(sum(count(*)) over (order by slot) - count(*) as bigint) as earlier from b group by slot)
 select task_id, cast(earlier + row_number() over (partition by b.slot order by decision_us, workflow, process, task_id) as bigint) as position from b join n on b.slot = n.slot""")
_add("jn05_prefix_errors", lambda e: f""", t as (select task_id, workflow, substr({e.sha('cast(task_id as string)')}, 1, 4) as prefix from tasks), c as (select prefix, count(*) as matches from t group by prefix)
 select t.task_id, t.prefix, matches, 'ambiguous' as problem from t join c on t.prefix = c.prefix where matches > 1""")
_add("hs08_six_scopes", f""", v as (select task_id, 'instance' as scope, workflow || '|' || process || '|' || task_instance as key, decision_us, completion_us, peak_bytes from tasks
 union all select task_id, 'input', input_identity, decision_us, completion_us, peak_bytes from tasks union all select task_id, 'process', workflow || '|' || process, decision_us, completion_us, peak_bytes from tasks
 union all select task_id, 'workflow', workflow, decision_us, completion_us, peak_bytes from tasks union all select task_id, 'all', 'all', decision_us, completion_us, peak_bytes from tasks
 union all select task_id, 'class', case when input_bytes >= 536870912 then 'large' else 'small' end, decision_us, completion_us, peak_bytes from tasks
 union all select task_id, 'class', case when consumed_bytes is null then 'unseen' else 'seen' end, decision_us, completion_us, peak_bytes from tasks),
 x as (select scope, key, task_id, decision_us as at_us, 0 as outcome, cast(0 as bigint) as bytes from v union all select scope, key, task_id, completion_us, 1, peak_bytes from v),
 b as (select *, {_HOUR.format('at_us')} as slot from x),
 h as (select scope, key, slot, sum(sum(outcome)) over (partition by scope, key order by slot) - sum(outcome) as n0, sum(sum(bytes)) over (partition by scope, key order by slot) - sum(bytes) as b0 from b group by scope, key, slot),
 r as (select *, sum(outcome) over (partition by scope, key, slot order by at_us, outcome, task_id rows between unbounded preceding and current row) as n1, sum(bytes) over (partition by scope, key, slot order by at_us, outcome, task_id rows between unbounded preceding and current row) as b1 from b)
 select task_id, r.scope, cast(sum(n0 + n1) as bigint) as support, cast(sum(b0 + b1) as bigint) as bytes from r join h on r.scope = h.scope and r.key = h.key and r.slot = h.slot where outcome = 0 group by task_id, r.scope""")
