from pyspark.sql import functions as F

from leadloom.functions import tokens
from leadloom.operators.enrich import relevance


def grades(spark, *rows):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, html string, query string")
    out = df.withColumn("body", tokens.page_text(F.col("html"))).withColumns(relevance(F.col("body"), F.col("query")))
    return [(r.lead_quality, r.keyword_match_pct) for r in out.orderBy("i").collect()]


def test_tokens(values):
    assert values(tokens.keyword_tokens, "The Roof-repairs, with roof and Éclair abc1 repairs", "", None) == [["roof", "repairs"], [], []]
    assert values(tokens.page_text, "<style>p{}</style><p>One&nbsp;&amp;\n Two</p><script>x<y</script><!-- c -->Three") == ["one & two three"]


def test_grades(spark):
    query = "roof repairs leeds builders"
    assert grades(
        spark,
        ("<p>Roof repairs in Leeds. Contact us!</p>", query), ("<p>Roof only</p>", query), ("<p>About us</p>", query), ("<p>nothing here</p>", query),
        ("<p>showing 12 results</p>", query), ("<p>Roof repairs Leeds: contact us. leave a comment</p>", query), ("<p>x</p>", "of to"),
    ) == [("HOT", 75), ("WARM", 25), ("WARM", 0), ("COLD", 0), ("NOISE", 0), ("HOT", 75), ("COLD", 0)]


def test_half_rounds_to_even(spark):
    words = "alpha bravo charlie delta echoes foxtrot golfing hotels"
    assert grades(spark, ("<p>alpha</p>", words), ("<p>alpha bravo charlie</p>", words)) == [("COLD", 12), ("WARM", 38)]
