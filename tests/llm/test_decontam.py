"""Decontamination: copies, re-parameterised questions, contradictions and clean documents."""

from pyspark.sql import functions as F

from salestide.llm import decontam

ITEM = "a train leaves Paris at 9 and drives 120 km to the next town where it waits 15 minutes before it goes on"
OTHER = "mix two cups of flour with water and salt and leave the dough to rest for an hour before you bake it"


def found(spark, texts, items=None):
    docs = spark.createDataFrame(list(texts), "doc_id long, text string")
    bench = spark.createDataFrame(items or [(1, ITEM), (2, OTHER), (3, "short one"), (4, None), (5, "")], "item_id long, text string")
    return sorted((r.doc, r.item, r.changed) for r in decontam.leaks(docs, bench).collect())


def test_copy_and_other_values(spark):
    filler = "other words stand before and after the question. "
    texts = [
        (1, filler + ITEM + ". " + filler), (2, filler + ITEM.replace("Paris", "New York").replace("120", "95").replace("9 ", "11 ").replace("15", "8")),
        (3, filler * 9), (4, None), (5, ""), (6, " ".join(ITEM.split()[:8])), (7, OTHER.upper()), (8, "It is a short one, really."),
    ]
    got = found(spark, texts)
    assert (1, 1, 0) in got and (2, 1, 4) in got and (7, 2, 0) in got and (8, 3, 0) in got
    assert {d for d, _, _ in got} == {1, 2, 7, 8}


def test_contradicting_values_are_no_match(spark):
    item = "add 5 to the number and then take 5 from the number so that 5 and nothing else is left at the end"
    consistent = item.replace("5", "7")
    broken = item.replace("add 5", "add 7").replace("take 5", "take 8")
    assert found(spark, [(1, consistent), (2, broken), (3, item)], [(9, item)]) == [(1, 9, 1), (3, 9, 0)]


def test_clean_keeps_rows_and_columns(spark):
    docs = spark.createDataFrame([(1, ITEM, 1), (2, "clean text of its own", 2), (2, "clean text of its own", 2), (None, None, 3), (None, ITEM, 4)],
                                 "doc_id long, text string, item long")
    bench = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    kept = decontam.clean(docs, bench)
    assert kept.columns == docs.columns and sorted(r.item for r in kept.collect()) == [2, 2, 3]
    assert decontam.clean(docs, bench.where("item_id < 0")).count() == 5
    assert decontam.clean(docs.where("item < 0"), bench).count() == 0


def test_verbatim_item_beside_a_contradicting_variant(spark):
    item = "add 5 to the number and then take 5 from the number so that 5 and nothing else is left at the end"
    broken = item.replace("add 5", "add 7").replace("take 5", "take 8")
    texts = [(1, f"{broken}. then again {item}."), (2, f"{item}. then again {broken}."), (3, f"{broken}. then again {broken}.")]
    assert found(spark, texts, [(9, item)]) == [(1, 9, 0), (2, 9, 0)]
    # a capital at the start is a name in both
    upper = item.replace("add", "Add", 1)
    assert found(spark, [(1, f"{broken.replace('add', 'Add', 1)}. they said, {upper}.")], [(9, upper)]) == [(1, 9, 0)]


def test_names_that_open_sentences(spark):
    item = "Anna buys 4 apples in the morning. Anna eats one of them at noon. Anna gives the rest to a friend. How many apples does the friend get?"
    other = item.replace("Anna", "Maria Lopez").replace("4", "9")
    broken = item.replace("Anna buys", "Maria buys").replace("Anna eats", "Eva eats")
    glued = "They asked New " + item
    twice = "The river is long and slow here. The river is long and wide there. The bridge is old"
    texts = [(1, item), (2, other), (3, broken), (4, glued), (5, "So says Paul " + twice), (6, "unrelated words only")]
    assert found(spark, texts, [(1, item), (2, twice)]) == [(1, 1, 0), (2, 1, 2), (4, 1, 0), (5, 2, 0)]


def test_long_text_and_repeated_rows(spark):
    long = "Words of no use 7 times. " * 20_000
    got = found(spark, [(1, long + ITEM + ". " + long), (2, long), (3, ITEM), (3, ITEM)])
    assert got == [(1, 1, 0), (3, 1, 0)]


def test_endless_runs_of_names_and_numbers(spark):
    names, numbers = "Anna Maria's " * 30_000, "1.2,3:4/" * 30_000
    assert found(spark, [(1, f"{names}. {ITEM}. {numbers}"), (2, names), (3, numbers)]) == [(1, 1, 0)]


def test_possessive_patterns_match_alike(spark):
    rows = spark.createDataFrame([(t,) for t in ("Anna Maria-Eva B. O'Neil's d'Or Ab A", "1.2. 3,,4 5:6/ 7", "É Été Ça-va Bien  Non", "")], "t string")
    for plain, fast in ((decontam.NAME, decontam._NAME), (decontam.NUMBER, decontam._NUMBER)):
        same = [F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (plain, fast)]
        assert rows.where(same[0] != same[1]).count() == 0
