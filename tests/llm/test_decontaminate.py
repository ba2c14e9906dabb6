"""Leaks against a brute-force search, and planted questions with other values."""

import regex

from gaugeline.llm import decontaminate as dc


def plain_tokens(text):
    text = regex.sub(r"[#=]", "", text or "")
    text = regex.sub(dc._UNIT, "#u", regex.sub(dc._NUMBER, "#n", text))
    text = regex.sub(r"(?<=[\p{L}\p{N},;:]\s)\p{Lu}\p{Ll}+(?![\p{L}\p{N}])", "#a", text)
    return regex.sub(r"[^\p{L}\p{N}#=]+", " ", text.lower()).split()


def spans(tokens):
    if len(tokens) < dc.WINDOW:
        return [tuple(tokens)] if tokens else []
    return [tuple(tokens[i : i + dc.WINDOW]) for i in range(len(tokens) - dc.WINDOW + 1)]


def brute(docs, items, share=0.8):
    found = set()
    known = {}
    for item, text in items:
        t = plain_tokens(text)
        known[item] = [w for w in spans(t) if len(t) < dc.WINDOW or sum("#" not in x for x in w) >= dc.LITERALS]
    for doc, text in docs:
        have = set(spans(plain_tokens(text)))
        for item, want in known.items():
            if want and sum(w in have for w in want) >= share * len(want):
                found.add((doc, item))
    return found


def test_documents_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").select("item_id", "text")
    got = dc.leaks(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs.collect(), items.collect())
    assert got and all(r.verbatim for r in got)


ITEMS = [
    (1, "A train leaves Paris at 7:30 and Anna travels 120 km before she meets Omar after 2 hours."),
    (2, "If Anna gives Omar 5 apples and then Anna eats 3 apples, how many apples has Omar got from Anna?"),
    (3, "Why so"), (4, None), (None, "no id at all for this one here"), (5, "1 2 3 4 5 6 7"),
]


def test_other_values_are_found_and_inconsistent_ones_are_not(spark):
    docs = [
        (1, "Some talk first. A train leaves Rome at 9:15 and Lena travels 80 miles before she meets Tom after 3 days. Bye"),
        (2, "If Lena gives Tom 7 apples and then Lena eats 2 apples, how many apples has Tom got from Lena?"),
        (3, "If Lena gives Tom 7 apples and then Olga eats 2 apples, how many apples has Tom got from Lena?"),
        (4, "nothing of the kind"), (5, ""), (6, None), (7, "WHY, so!"), (8, "8 9 8 9 8 9 8"),
        (None, ITEMS[0][1]), (9, ITEMS[0][1] + " " + ITEMS[1][1]), (9, ITEMS[0][1] + " " + ITEMS[1][1]),
    ]
    docs = spark.createDataFrame(docs, "doc_id bigint, text string").selectExpr("*", "1 AS item_id", "2 AS w")
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").selectExpr("*", "1 AS doc_id")
    got = {(r.doc_id, r.item_id): r for r in dc.leaks(docs, items).collect()}
    assert set(got) == {(1, 1), (2, 2), (7, 3), (None, 1), (9, 1), (9, 2)}
    assert not got[1, 1].verbatim and not got[2, 2].verbatim and got[9, 2].verbatim
    clean = dc.without_leaks(docs, items)
    assert clean.columns == docs.columns
    assert sorted(str(r.doc_id) for r in clean.collect()) == ["3", "4", "5", "6", "8"]
    assert dc.leaks(docs.where("false"), items).collect() == []
    assert dc.without_leaks(docs, items.where("false")).count() == 11


def test_both_forms_of_tokens_have_the_same_places(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([("x 1,000.5km 3/4 a#b=c 12-13 'Tis 5 KG — ½ ² n min",)], "text string")
    rows = docs.select("text").unionAll(odd)
    bad = rows.where(F.size(dc.tokens(F.col("text"))) != F.size(dc.tokens(F.col("text"), values=True)))
    assert bad.count() == 0


def found(spark, docs, items):
    docs = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    items = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    return {(r.doc_id, r.item_id): r for r in dc.leaks(docs, items).collect()}


def test_short_items_and_items_of_placeholders_are_found_in_longer_texts(spark):
    items = {1: "Who discovered penicillin first?", 2: "Compute 12 + 7 * 3 - 4 + 5", 3: "Add 4", 4: "Photosynthesis", 5: "What is 2 + 2?"}
    docs = {
        1: "A quiz of the week. Who discovered penicillin first? Answers on the next page, as always.",
        2: "Now compute 12 + 7 * 3 - 4 + 5 and write the result down.",
        3: "Now compute 13 + 6 * 2 - 9 + 8 and write the result down.",
        4: "You may add 4 eggs to the bowl now", 5: "You may add 5 eggs to the bowl now",
        6: "Plants live by photosynthesis and by little else", 7: "who discovered it", 8: "so what is 3 + 3?",
    }
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (2, 2), (4, 3), (6, 4), (8, 5)}
    assert got[2, 2].verbatim and not got[8, 5].verbatim and got[1, 1].start == 5


APPLES = "Anna has 5 apples. Omar has 3 apples. Anna gives Omar 2 apples. How many apples does Omar have?"
BAKER = "Each morning the baker Anna takes 5 loaves to Omar and then Anna sells 3 loaves to other people in town."


def test_names_at_sentence_starts_every_offset_and_joined_units(spark):
    items = {1: APPLES, 2: BAKER, 3: "The lorry then drives 120 km along the river and stops for a rest."}
    lena, changed = (t.replace("Anna", "Lena").replace("Omar", "Tom") for t in (APPLES, BAKER))
    mixed = changed.replace("then Lena", "then Olga")
    docs = {
        1: lena.replace("5", "8"), 2: lena.replace("Lena gives", "Olga gives"), 3: f"{mixed} {BAKER}", 4: f"{mixed} {mixed}",
        5: "The lorry then drives 80km along the river and stops for a rest.", 6: f"{mixed} {changed}",
        7: f"({lena.replace('. ', '.  ')})", 8: BAKER.replace("baker Anna", "baker  \r\n Anna"),
    }
    got = found(spark, docs, items)
    assert set(got) == {(1, 1), (3, 2), (5, 3), (6, 2), (7, 1), (8, 2)}
    assert got[3, 2].verbatim and got[3, 2].start == 21 and not got[6, 2].verbatim and not got[1, 1].verbatim


def test_both_readings_have_the_same_places(spark):
    from pyspark.sql import functions as F

    odd = spark.createDataFrame([("x Anna's 5Anna 1,000.5km 12 KG 5Km =Anna #Anna \"Omar\" McAnna Ab-Cd. The Éa 3 Min",)], "text string")
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").unionAll(odd)
    sizes = [F.size(dc.tokens(F.col("text"), v, e)) for v in (False, True) for e in (False, True)]
    assert rows.where(F.greatest(*sizes) != F.least(*sizes)).count() == 0


def test_texts_under_one_item_id_are_items_of_their_own(spark):
    one = "Which of these rivers runs through the old town of the northern valley?"
    two = "Name the metal that melts at the lowest temperature among the listed ones."
    docs = spark.createDataFrame([(1, f"Notes. {one} More."), (2, f"Then {two}"), (3, "nothing of it here at all")], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, one), (7, two), (7, two), (None, one)], "item_id bigint, text string")
    got = dc.leaks(docs, items).collect()
    assert sorted((r.doc_id, r.item_id, r.windows == r.n_windows) for r in got) == [(1, 7, True), (2, 7, True)]
    assert [r.doc_id for r in dc.without_leaks(docs, items).collect()] == [3]


def test_a_very_long_text_is_read_to_its_end(spark):
    one = "Which of these rivers runs through the old town of the northern valley?"
    docs = spark.createDataFrame([(1, "Plain words, 12 of them. " * 60_000 + one), (2, "Plain words, 12 of them. " * 60_000)], "doc_id bigint, text string")
    items = spark.createDataFrame([(7, one)], "item_id bigint, text string")
    assert [(r.doc_id, r.start) for r in dc.leaks(docs, items).collect()] == [(1, 300_000)]


def test_windows_are_rows_and_no_lambda_runs_for_each(spark):
    from pyspark.sql import functions as F

    text = "Anna met Omar at noon. Lena has 12 km to go, Tom has 3. Then Anna rests"
    rows = spark.createDataFrame([(1, 5, text), (2, 5, "two words"), (3, 5, " - "), (4, 5, "Go")], "doc_id bigint, text_hash bigint, text string")

    def windows(widths, valued=False):
        known = spark.createDataFrame([(w, valued) for w in widths], "width int, valued boolean")
        return dc.document_windows(rows, known)

    assert windows([2, 5])._jdf.queryExecution().executedPlan().toString().count("lambdafunction(") == 1  # the cut into tokens
    forms = rows.select("doc_id", dc.tokens(F.col("text")), dc.tokens(F.col("text"), every=True), dc.tokens(F.col("text"), values=True)).collect()
    seen = {}
    for widths in ([1], [3], [5], [1, 3, 5]):
        want, shown = [], []
        for doc, t, e, v in forms:
            for w in widths:
                for p in range(len(t) - w + 1):
                    sure, every = tuple(t[p : p + w]), tuple(e[p : p + w])
                    want += [(doc, p, True, sure == every, sure)] + [(doc, p, False, True, every)] * (sure != every)
                    shown.append((doc, p, True, True, ("values", *v[p : p + w])))
        for valued, expected in ((False, want), (True, shown)):
            got = sorted((r.doc_id, r.dpos, r.sure, r.every, r.w) for r in windows(widths, valued).collect())
            assert [g[:4] for g in got] == sorted(x[:4] for x in expected)
            if len(widths) == 1:
                for x, r in zip(sorted(expected), got):
                    assert seen.setdefault(x[4], r[4]) == r[4]
            else:
                assert sorted(r[4] for r in got) == sorted(seen[x[4]] for x in expected)
    assert len(set(seen.values())) == len(seen)


def test_lower_case_of_a_token_does_not_depend_on_its_neighbours(spark):
    from pyspark.sql import functions as F

    text = "ΟΔΟΣ'ΑΣ Σ.Α ΣΑΣ-ΣΑ (İstanbul) İ"
    pieces = F.transform(F.split(F.lit(text), r"[^\p{L}]+"), F.lower)
    row = spark.range(1).select(dc.tokens(F.lit(text)).alias("got"), pieces.alias("want")).first()
    assert row.got == [t for t in row.want if t] and "οδος" in row.got and "i̇stanbul" in row.got
