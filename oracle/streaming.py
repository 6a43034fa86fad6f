"""Final state of the streaming queries."""

from oracle.views import q

SQL = {}
SQL["stream_ingest"] = q("""
SELECT event_id, task_id, status, latency_sec, k, epoch_us(ts) AS ts_micros FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY ts) AS rn FROM stream) WHERE rn = 1""", "stream")
SQL["stream_metrics"] = q("""
SELECT status, done, completed, greatest(0, total - completed) AS remaining, round(s, 4) AS elapsed_sec,
       round(s / done, 6) AS avg_sec_per_row, round(spent / completed * greatest(0, total - completed), 4) AS eta_sec
FROM per CROSS JOIN run""", "stream", "tasks",
    per="SELECT status, count(*) AS done, sum(latency_sec) AS s FROM stream GROUP BY status",
    run="SELECT CAST(sum(done) AS BIGINT) AS completed, sum(s) AS spent, (SELECT 8 * count(*) FROM tasks) AS total FROM per")
