"""Query of the repeated-passage operator."""

from pyspark.sql import functions as F

from salestide.llm import repeats
from salestide.llm.common import table


def op6_repeated_passages(spark, folder):
    found = repeats.without_repeats(table(spark, folder, "documents").select("doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0), lambda n, s: n + s["stop"] - s["start"])
    return found.select(
        F.col("row.doc_id").alias("doc_id"), F.col("n_bytes").cast("long").alias("n_bytes"), removed.cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


QUERIES = {"op6_repeated_passages": op6_repeated_passages}

# every window of 400 bytes, as hexadecimal text
ORACLES = {"op6_repeated_passages": """
with d as (select doc_id, hex(encode(coalesce(text,''))) h from documents),
w as (select doc_id, unnest(range(0, length(h)//2-399)) p, h from d where length(h) >= 800),
m as (select doc_id, p, md5(substr(h, 2*p+1, 800)) x from w),
r as (select doc_id, p from (select *, count(*) over (partition by x) n from m) where n>1),
s as (select doc_id, p, coalesce(p > 400 + lag(p) over (partition by doc_id order by p), true) fresh from r),
i as (select doc_id, p, count(*) filter (fresh) over (partition by doc_id order by p) island from s),
j as (select doc_id, min(p) a, max(p)+400 b from i group by doc_id, island),
k as (select doc_id, count(*) n_spans, sum(b-a) n_removed, list(a order by a) starts, list(b order by a) stops from j group by doc_id),
o as (select d.doc_id, length(h)//2 n_bytes, coalesce(n_removed,0) n_removed, coalesce(n_spans,0) n_spans, h,
  list_prepend(0, coalesce(stops,[])) f, list_append(coalesce(starts,[]), length(h)//2) t from d left join k using (doc_id))
select doc_id, cast(n_bytes as bigint) n_bytes, cast(n_removed as bigint) n_removed, cast(n_spans as bigint) n_spans,
 sha256(unhex(array_to_string(list_transform(range(1, len(f)+1), lambda q: substr(h, 2*f[q]+1, 2*(t[q]-f[q]))),''))) kept_sha256 from o"""}
