"""Query of the mixing operator."""

from pyspark.sql import functions as F

from salestide.llm import mixing
from salestide.llm.common import table


def op8_source_mixing(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    # the text is counted before rows move, so it does not travel
    narrow = docs.select("doc_id", "source", mixing.word_count(F.col("text")).alias("words"))
    plan = mixing.planned(narrow, text="words", counted=True)
    return plan.select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


QUERIES = {"op8_source_mixing": op8_source_mixing}

ORACLES = {"op8_source_mixing": r"""
with d as (select doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\x20\x09-\x0D]+')) size,
  md5(coalesce(cast(doc_id as varchar),'')) mark from documents),
b as (select *, lpad(cast(length(bin(size)) as varchar),2,'0')||substr(bin(size),1,3) band from d),
s as (select source, cast(sum(size) as bigint) source_size from d group by source),
w as (select *, (row_number() over (order by source nulls last)-1)%3+1 weight from s),
r as (select *, 3*source_size/weight room from w),
l as (select *, (sum(source_size) over () - 3*coalesce(sum(source_size) over (order by room, source nulls last rows between unbounded preceding and 1 preceding),0))
  /(sum(weight) over () - coalesce(sum(weight) over (order by room, source nulls last rows between unbounded preceding and 1 preceding),0)) lev from r),
t as (select source, source_size, least(cast(3*source_size as double), weight*(select arg_min(lev, room) from l where lev <= room)) target from l),
o as (select *, case when source_size>0 then least(3.0::double, target/source_size) else 0 end rate,
  cast(('0x'||substr(md5('mix-1'||coalesce('='||source,'')),1,5)) as integer)/1048576.0::double shift from t),
n as (select doc_id, size, o.source_size, target, rate, shift,
  cast(row_number() over (partition by b.source order by band, mark) as double) k from b join o on b.source is not distinct from o.source)
select doc_id, cast(size as bigint) size, source_size, target,
  cast((floor(k*rate+shift)-floor((k-1)*rate+shift))*size as bigint) taken from n"""}
