from pyspark.sql import functions as F

from salestide.operators import recipes as rcp
from salestide.plans.registry import query
from salestide.sources.views import recipe_view

_N = ",".join(rcp.NUTRIENTS)
RECIPES = """with rv0 as (select 'R'||lpad(((p_partkey//100)%1000)::varchar,3,'0')||'S'||lpad((p_partkey%100)::varchar,2,'0')||'V'||(p_size%10) product_id,
  p_name||' '||lower(p_type) product_name, (p_size+10)||' g' portion_size, replace(p_name,' ',', ') ingredients_raw, list_append(string_split(p_name,' '), lower(p_type)) ingredients_list,
  case when p_size>30 then 'contains milk, '||string_split(p_name,' ')[1]||' and traces of nuts' when p_size>10 then 'Gluten; soy.' end allergens,
  case when p_size>40 then 'milk proteins' when p_size>25 then 'Soy protein' when p_size>12 then 'soy proteins' end protein_source, 'sheet_'||p_partkey||'.txt' source_file,
  case when p_size>5 then p_retailprice/5 end::decimal(8,2) kcal_100g, case when p_size>5 then p_retailprice*4/5 end::decimal(8,2) kj_100g, (p_size/2.0)::decimal(8,2) matieres_grasses_100g, (p_size/2.0)::decimal(8,2) lipides_100g,
  (p_size/6.0::double)::decimal(8,2) acides_gras_satures_100g, (p_size*1.2)::decimal(8,2) glucides_100g, case when p_size>3 then p_size/4.0 end::decimal(8,2) sucres_100g, (p_size*0.3)::decimal(8,2) amidon_100g, ((50-p_size)/10.0)::decimal(8,2) fibres_100g,
  case when p_size<48 then (50-p_size)/2.0 end::decimal(8,2) proteines_100g, (p_size/50.0)::decimal(8,2) sel_100g, timestamp '2024-01-31 00:00:00' - to_hours(p_size) updated_at from part),"""


def _contains(col, words):
    return "(" + " or ".join(f"contains(lower({col}),'{w}')" for w in words) + ")"


def _chain(col, rules):
    return "case " + " ".join(f"when {_contains(col, w)} then '{t}'" for t, w in rules) + " end"


_TAGS = ",".join([_chain("product_name", r) for r in rcp.NAME_TAGS] + [_chain("protein_source", rcp.PROTEIN_TAGS)] + [
    "case when nullif(proteines_100g,0)>=20 then 'High Protein' when nullif(proteines_100g,0)>=15 then 'Medium Protein' end",
    "case when nullif(kcal_100g,0)<=100 then 'Low Calorie' when nullif(kcal_100g,0)>=400 then 'High Calorie' end",
    "case when nullif(lipides_100g,0)<=3 then 'Low Fat' when nullif(lipides_100g,0)>=15 then 'High Fat' end",
])
RECIPES += f" rv as (select *, list_sort(list_distinct(list_filter([{_TAGS}], lambda x: x is not null))) tags from rv0)"


def _recipes(spark, d):
    return rcp.with_tags(recipe_view(spark, d))


def rquery(name, sql=None, floats=""):
    return query(name, sql, floats, base=RECIPES)


@rquery("rcp_01_tags", "select source_file, array_to_string(tags, '|') tags from rv")
def _(spark, d):
    return _recipes(spark, d).select("source_file", F.array_join("tags", "|").alias("tags"))


@rquery(
    "rcp_02_search",
    """select product_id, source_file, product_name, kcal_100g from rv where (contains(lower(product_name),'ring') or contains(lower(product_name),'small'))
     and (contains(lower(protein_source),'soy')) and not coalesce(contains(lower(ingredients_raw),'red'),false) and not list_contains(list_transform(ingredients_list, lambda x: contains(lower(x),'red')), true)
     and (list_contains(list_transform(tags, lambda x: contains(lower(x),'calorie')), true) or list_contains(list_transform(tags, lambda x: contains(lower(x),'protein')), true))
     and proteines_100g>=5 and lipides_100g<=18""",
)
def _(spark, d):
    found = rcp.search(
        _recipes(spark, d),
        {"product_name": ["ring", "SMALL", " "], "protein_source": ["soy"], "tags": ["calorie", "protein"]},
        ["red"], {"proteines_100g": (5, None), "lipides_100g": (None, 18)},
    )
    return found.select("product_id", "source_file", "product_name", "kcal_100g")


@rquery(
    "rcp_03_grouped_pages",
    "select product_id, source_file, coalesce(tags[1],'Other') tag_group, row_number() over (order by product_id, source_file) position, ceil(row_number() over (order by product_id, source_file)/24.0)::integer page from rv",
)
def _(spark, d):
    return rcp.grouped_pages(_recipes(spark, d))


@rquery("rcp_04_distinct_tags", "select distinct unnest(tags) tag from rv")
def _(spark, d):
    return rcp.distinct_tags(_recipes(spark, d))


@rquery("rcp_04_distinct_ingredients", "select distinct trim(replace(i,'&','')) ingredient from (select unnest(ingredients_list) i from rv) where trim(replace(i,'&',''))<>''")
def _(spark, d):
    return rcp.distinct_ingredients(_recipes(spark, d))


@rquery(
    "rcp_05_distinct_allergens",
    """, e as (select distinct trim(unnest(string_split_regex(allergens,'[;,]'))) e from rv where allergens is not null), f as (select trim(regexp_replace(regexp_replace(e,'\\s*\\.\\s*contient.*$','','i'),'\\s*\\.\\s*gluten.*$','','i')) e from e where e<>'')
    select distinct upper(e[1])||lower(e[2:]) allergen from f where e<>'' and lower(e) not in ('contient','none','none contain','no contain','no contains','contain','contains','. contient')""",
)
def _(spark, d):
    return rcp.distinct_allergens(_recipes(spark, d))


@rquery(
    "rcp_06_distinct_proteins",
    """, e as (select distinct trim(unnest(string_split_regex(protein_source,'[;,]'))) e from rv where protein_source is not null),
    k as (select case when lower(e) like '%s' and length(e)>3 then lower(e)[:-2] else lower(e) end k, e, row_number() over (partition by case when lower(e) like '%s' and length(e)>3 then lower(e)[:-2] else lower(e) end order by lower(e) like '%s', lower(e)) p from e where e<>'')
    select upper(e[1])||lower(e[2:]) protein_source from k where p=1""",
)
def _(spark, d):
    return rcp.distinct_proteins(_recipes(spark, d))


@rquery("rcp_07_valid_product_ids", "select distinct product_id from rv where length(product_id)>=3 and not contains(product_id,'/')")
def _(spark, d):
    return rcp.valid_product_ids(_recipes(spark, d))


@rquery("rcp_07_distinct_portions", "select distinct portion_size from rv")
def _(spark, d):
    return rcp.distinct_values(_recipes(spark, d), "portion_size")


@rquery(
    "rcp_08_nutrition_stats",
    " union all ".join(f"select '{c}' nutrient, sum({c})::double/count({c}) mean, min({c})::double \"min\", max({c})::double \"max\" from rv" for c in rcp.NUTRIENTS),
    floats="mean",
)
def _(spark, d):
    return rcp.nutrition_stats(_recipes(spark, d))


@rquery("rcp_09_top_portions", 'select portion_size "value", count(*) recipes from rv group by 1 order by 2 desc, 1 limit 10')
def _(spark, d):
    return rcp.top_values(_recipes(spark, d), "portion_size")


@rquery("rcp_09_top_tags", 'select t "value", count(*) recipes from (select unnest(tags) t from rv) group by 1 order by 2 desc, 1 limit 10')
def _(spark, d):
    return rcp.top_values(_recipes(spark, d), "tags")


@rquery(
    "rcp_10_macro_rows",
    "select product_id, source_file, proteines_100g, glucides_100g, lipides_100g, kcal_100g from rv where proteines_100g is not null and kcal_100g is not null order by 1,2 limit 20",
)
def _(spark, d):
    return rcp.macro_rows(_recipes(spark, d))


@rquery(
    "rcp_11_quality_scores",
    """select product_id, source_file, (case when proteines_100g>10 then 2 else 0 end+case when fibres_100g>3 then 2 else 0 end+case when sucres_100g<5 and sucres_100g<>0 then 1 else 0 end) quality_score, kcal_100g
    from rv where kcal_100g is not null and proteines_100g is not null and fibres_100g is not null and sucres_100g is not null""",
)
def _(spark, d):
    return rcp.quality_scores(_recipes(spark, d))


_P = [c.replace("_100g", "_portion") for c in rcp.NUTRIENTS]


@rquery(
    "rcp_12_portion", "select source_file, " + ", ".join(f"{c}::double*40/100.0 {p}" for c, p in zip(rcp.NUTRIENTS, _P)) + " from rv", floats=" ".join(_P),
)
def _(spark, d):
    return rcp.scale_portion(_recipes(spark, d), 40)


@rquery("rcp_12_portion_for_energy", "select source_file, 200/nullif(kcal_100g::double,0)*100 grams from rv", floats="grams")
def _(spark, d):
    return rcp.portion_for_energy(_recipes(spark, d), 200)


@rquery("rcp_13_activity", "select count(*) recipes, count(*) filter (updated_at>=timestamp '2024-01-31 00:00:00' - interval 24 hour) recent from rv")
def _(spark, d):
    return rcp.activity(_recipes(spark, d), F.lit("2024-01-31 00:00:00").cast("timestamp"))
