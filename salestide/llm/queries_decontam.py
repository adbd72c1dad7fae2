"""Query of the decontamination operator."""

from pyspark.sql import functions as F

from salestide.llm import decontam
from salestide.llm.common import table


def op9_decontamination(spark, folder):
    docs = table(spark, folder, "documents").select("doc_id", "text")
    found = decontam.leaks(docs, table(spark, folder, "benchmark"))
    return found.select(
        F.col("doc").alias("doc_id"), F.col("item").alias("item_id"), "matched", "windows",
        F.when(F.col("changed") > 0, "re-parameterised").otherwise("copy").alias("kind"),
    )


QUERIES = {"op9_decontamination": op9_decontamination}


def _tokens(values: bool) -> str:
    slot = (lambda kind, n: rf" ‹{kind}:\{n}› ") if values else (lambda kind, n: f" ‹{kind}› ")
    text = "translate(coalesce(text,''),'‹›','  ')"
    text = rf"regexp_replace({text}, '(^|[^\p{{L}}])({decontam.NAME.replace(chr(39), chr(39) * 2)})', '\1{slot('name', 2)}', 'g')"
    text = f"regexp_replace({text}, '({decontam.NUMBER})', '{slot('num', 1)}', 'g')"
    text = rf"regexp_replace({text}, '(?i)(‹num[^›]*› ) ?-?({decontam.UNITS})($|[^\p{{L}}])', '\1{slot('unit', 2)}\3', 'g')"
    return f"regexp_extract_all(lower({text}), '{decontam.TOKEN}')"


ORACLES = {"op9_decontamination": rf"""
with d as (select doc_id, {_tokens(False)} t, {_tokens(True)} v from documents),
b as (select item_id, {_tokens(False)} t, {_tokens(True)} v from benchmark),
bw as (select item_id, q, array_to_string(t[q:q+4],' ') w, t[q:q+4] tt, [regexp_extract(x, ':(.*)›', 1) for x in v[q:q+4]] vv
  from (select *, unnest(range(1, greatest(len(t)-3, 2))) q from b where len(t)>0)),
dw as (select doc_id, p, array_to_string(t[p:p+4],' ') w, [regexp_extract(x, ':(.*)›', 1) for x in v[p:p+4]] vv
  from (select *, unnest(range(1, greatest(len(t)-3, 2))) p from d where len(t)>0)),
tot as (select item_id, count(distinct w) windows from bw group by 1),
met as (select doc_id, item_id, p-q shift, q, bw.w, tt, bw.vv own,
  case when q=1 and tt[1]='‹name›' and ends_with(dw.vv[1], ' ' || bw.vv[1]) then list_prepend(bw.vv[1], dw.vv[2:]) else dw.vv end other from dw join bw on dw.w=bw.w),
cand as (select doc_id, item_id, count(distinct w) matched, any_value(windows) windows from met join tot using (item_id) group by 1,2
  having count(distinct w) >= 0.8*any_value(windows)),
-- every alignment with its distinct slots: one value of the item, one of the document
sl as (select distinct doc_id, item_id, shift, tt[k] kind, own[k] own, other[k] other from (select *, unnest(range(1,6)) k from met) where tt[k] like '‹%'),
ok as (select doc_id, item_id, shift, count(*) pairs, count(distinct kind || own) slots, count(*) filter (own<>other) changed from sl group by 1,2,3),
ln as (select doc_id, item_id, shift, count(*) n, count(distinct w) own from met group by 1,2,3),
al as (select ln.*, matched, windows, coalesce(changed,0) changed, coalesce(pairs,0)=coalesce(slots,0) fits from ln join cand using (doc_id, item_id) left join ok using (doc_id, item_id, shift)),
best as (select doc_id, item_id, any_value(matched) matched, any_value(windows) windows, arg_max(changed, n*1000000000-shift) changed, arg_max(fits, n*1000000000-shift) fits,
  arg_max(changed, n*1000000000-shift) filter (fits and own >= 0.8*windows) whole from al group by 1,2)
select doc_id, item_id, matched, windows, case when (case when fits then changed else whole end)>0 then 're-parameterised' else 'copy' end kind
from best where fits or whole is not null"""}
