"""Queries on jobs: user events as the events of ingest jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources.claims import table
from ..sources.scratch import fresh_folder
from ..streaming import jobs


def _events(spark, sf_dir):
    """Sign-ups queue a job, views and clicks move it to a stage, errors fail it, purchases complete it."""
    action = F.when(F.col("event_type") == "signup", "queue").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "purchase", "complete").otherwise("step")
    stage = F.when(action == "step", F.element_at(F.lit(jobs.STAGES[1:6]), (F.col("event_id") % 5 + 1).cast("int")))
    error = F.when(action == "fail", F.concat(F.lit("can't read /srv/in/"), F.col("event_id").cast("string"), F.lit(".pdf")))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("at"), "event_id", action.alias("action"), stage.alias("stage"), error.alias("error"))


def st03_jobs(spark, sf_dir):
    """All events as a stream; the last state of every job, with those whose time has run out."""
    folder = fresh_folder(spark, "jobs")
    rows = _events(spark, sf_dir)
    rows.write.parquet(f"{folder}/in")
    return jobs.run(spark.readStream.schema(rows.schema).parquet(f"{folder}/in"), folder)


QUERIES = {"ST-03_jobs": st03_jobs}

_OF = "list_position([" + ", ".join(f"'{s}'" for s in jobs.STAGES) + "], {}) - 1"
#: One event of every job at a time; a job whose patience has run out fails before the event.
_STEPS = f"""
    with recursive e as (select user_id as job, row_number() over (partition by user_id order by ts, event_id) as n, epoch_us(ts) as us, event_type as kind, cast(event_id % 5 + 1 as integer) as rank from events),
    s(job, n, stage, status, attempts, error, updated, accepted, ignored) as (
        select distinct job, cast(0 as bigint), cast(null as varchar), cast(null as varchar), 0, cast(null as varchar), cast(0 as bigint), 0, 0 from e
        union all
        select job, n, case when not ok then stage when kind = 'signup' then 'queued' when kind = 'error' then 'failed' when kind = 'purchase' then 'completed' else ['parsing', 'extracting', 'resolving', 'adjudicating', 'storing'][rank] end,
            case when not ok then status when kind = 'signup' then 'queued' when kind = 'error' then 'failed' when kind = 'purchase' then 'completed' else 'processing' end,
            attempts + case when ok and kind = 'signup' then 1 else 0 end, case when not ok then error when kind = 'signup' then null when kind = 'error' then 'can''t read <path>' else error end,
            case when ok then us else updated end, accepted + case when ok then 1 else 0 end, ignored + case when ok then 0 else 1 end
        from (select *, case kind when 'signup' then status is null or (status = 'failed' and attempts < {jobs.ATTEMPTS}) when 'error' then coalesce(status in ('queued', 'processing'), false) when 'purchase' then coalesce(status = 'processing', false)
                else coalesce(status in ('queued', 'processing') and rank >= {_OF.format('stage')}, false) end as ok
            from (select job, n, attempts, us, kind, rank, accepted, ignored, case when late then 'failed' else stage end as stage, case when late then 'failed' else status end as status,
                    case when late then '{jobs.TIMED_OUT}' else error end as error, case when late then updated + {jobs.PATIENCE} else updated end as updated
                from (select s.job, e.n, stage, status, attempts, error, updated, accepted, ignored, us, kind, rank, coalesce(status in ('queued', 'processing') and us - updated > {jobs.PATIENCE}, false) as late from s join e on e.job = s.job and e.n = s.n + 1)))
    ), l as (select * from s qualify row_number() over (partition by job order by n desc) = 1),
    m as (select *, coalesce(status in ('queued', 'processing') and (select max(us) from e) - 600000000 - updated > {jobs.PATIENCE}, false) as late from l)
    select job as job_id, case when late then 'failed' else stage end as stage, case when late then 'failed' else status end as status, attempts, case when late then '{jobs.TIMED_OUT}' else error end as error,
        case when late then updated + {jobs.PATIENCE} else updated end as updated, accepted, ignored from m
"""
SQL = {"ST-03_jobs": _STEPS}
