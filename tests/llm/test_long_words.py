"""The quality classifier judges words of any length by all of their characters."""

import time

from tidemark.llm import quality_model


def test_long_words_count_whole():
    shapes, clean = quality_model.Shapes(), "Thequickbrownfoxjumpsoverthelazydogagain" * 2
    of = lambda text: dict(zip(*quality_model.features(text, shapes), strict=True))
    symbols, signs = of(clean + "#*$%&|" * 2_000), of("#*$% *$%& $%&| %&|# &|#* |#*$")
    assert of(clean) != symbols
    common = [s for s in signs if s in symbols and s not in of(clean)]
    assert len(common) >= 6 and sum(symbols[s] ** 2 for s in common) > 0.9
    start = time.process_time()
    of("aB3#" * 500_000)
    assert time.process_time() - start < 10


def test_quality_of_a_text_without_blanks_is_that_of_all_of_it(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    clean = "and".join(["thing", "matter", "people", "country", "morning", "evening", "water", "letter"] * 2)
    texts = spark.createDataFrame([(1, clean), (2, clean + "#*$%&|<>#$" * 1_000)], "doc_id long, text string")
    scores = {r.doc_id: r.score for r in quality_model.fit(table).score(texts, ("doc_id",)).collect()}
    assert scores[2] < scores[1] - 0.1
