from pyspark.sql import functions as F

from lakewright.functions import stemming, text as tx


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("x")).first().x


def test_clean(spark):
    assert one(spark, "  a &amp; b\n\tc ", tx.clean) == "a & b c"
    assert one(spark, " \n ", tx.clean) is None and one(spark, None, tx.clean) is None
    assert one(spark, "Farm,Rural &amp; Land", tx.clean_category) == "Farm, Rural & Land"
    once = one(spark, "x,y", tx.clean_category)
    assert one(spark, once, tx.clean_category) == once


def test_fold_and_terms(spark):
    assert one(spark, "Tamil Nadu", tx.fold) == "tamil nadu"
    assert one(spark, "Jammu & Kashmir.", tx.fold) == "jammu and kashmir"
    assert one(spark, "I am a widow in Punjab, what pension can I get?", tx.query_terms) == ["widow", "punjab", "pension"]
    assert one(spark, "widow | widow & (drop)", tx.any_term_query) == "widow | drop"
    assert one(spark, None, tx.query_terms) == [] and one(spark, "मैं", tx.query_terms) == []


def test_lists(spark):
    assert one(spark, "1. Fill the form 2. Submit it 3. Collect receipt", tx.to_list) == ["Fill the form", "Submit it", "Collect receipt"]
    assert one(spark, "Form 3. and Form 7. required", tx.to_list) == ["Form 3. and Form 7. required"]
    assert one(spark, "Rs. 2. 5 lakh receipt", tx.to_list) == ["Rs. 2. 5 lakh receipt"]
    assert one(spark, "- one\n- two", tx.to_list) == ["one", "two"]
    assert one(spark, "one\n\n two ", tx.to_list) == ["one", "two"]
    assert one(spark, "  ", tx.to_list) == [] and one(spark, None, tx.to_list) is None
    assert one(spark, '{"at_first": ["a", "b"], "later": "c"}', tx.json_to_list) == ["at first: a", "at first: b", "later: c"]
    assert one(spark, '[{"name": "card", "note": "signed"}, ["x", null], 3]', tx.json_to_list) == ["card — signed", "x", "3"]
    assert one(spark, ["over 18", " resident "], tx.to_text, "array<string>") == "over 18; resident"
    assert one(spark, [], tx.to_text, "array<string>") is None
    assert one(spark, '{"phone": "1", "mail": "m"}', tx.json_to_text) == "1; m"


def test_json_recovery(spark):
    for reply in ('{"a": "}"}', '```json\n{"a": "}"}\n```', 'Here:\n{"a": "}"} done', ' {"a": "}"} '):
        assert one(spark, reply, tx.recover_json).startswith('{"a": "}"}')
    assert one(spark, 'x {"a": {"b": "\\"{"}} {"c": 1}', tx.recover_json) == '{"a": {"b": "\\"{"}}'
    assert one(spark, "none", tx.recover_json) == "none"
    assert one(spark, '{"d": {"results": [{"k": 1}], "total": 9}}', tx.find_results) == ['{"k": 1}']
    assert one(spark, '{"d": {"results": [], "totalCount": 9}}', tx.find_total) == 9
    assert one(spark, "broken", tx.find_results) is None
    page = 'x {\\"subs\\":{\\"results\\":[{\\"id\\":\\"1\\",\\"t\\":\\"a\\u0026b\\"}]}} y'
    assert len(one(spark, page, lambda c: tx.embedded_json(c, "subs"))) == 1


def test_spacing(spark):
    marks = one(spark, "r e m u n e r a t i v e prices", tx.spacing)
    assert marks.spaced_runs >= 1 and marks.single_pct > 8
    assert one(spark, "Deputationofprogressivefarmerstomainland", tx.spacing).glued == 1
    assert one(spark, "", tx.spacing).single_pct == 0
    pick = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(tx.better_text(F.col("a"), F.col("b")).alias("x")).first().x
    good, bad = "plain words of a text that is fine", "Deputationofprogressivefarmers x"
    assert pick(bad, good) == good and pick(good, bad) == good and pick(bad, "tiny") == bad


def test_small_functions(spark):
    assert one(spark, "api_key=abc&x Bearer tok sk-12345678", tx.redact) == "api_key=***&x Bearer *** sk-12345678***"
    assert one(spark, "Sub- sequently AB 12", tx.recall_tokens) == ["subsequently"]
    assert one(spark, "Oops: Page not found", tx.looks_missing)
    assert one(spark, "https://x.org/", tx.is_deep_link) is False and one(spark, "https://x.org/a", tx.is_deep_link)
    assert one(spark, "<p>a</p><script>x</script><nav>n</nav>b", tx.strip_html) == "a b"
    assert tx.chunked(["a b", "c", "d e f g h"], 3) == ["a b\nc", "d e f ", "g h"]
    assert tx.chunked(["日本語"], 2) == ["日本", "語"]
    assert tx.chunked(None, 3) is None and tx.chunked([], 3) == []
    assert one(spark, ["<tr>a b</tr>", "<tr>c</tr>"], lambda c: tx.split_table(c, 2), "array<string>") == ["<table><tr>a b</tr></table>", "<table><tr>c</tr></table>"]


def test_stems():
    said = "consistency running flies generously relational hopping hoped sensational happiness agreed"
    assert [stemming.stem(w) for w in said.split()] == "consist run fli generous relat hop hope sensat happi agre".split()


def test_all_terms_have_sql(duck):
    """The SQL of any_term_query repeats no term and goes on to the twelfth."""
    from lakewright import plans

    text = "widow Widow pension " + " ".join(f"term{c * 3}" for c in "abcdefghijklm")
    got = duck.execute(f"WITH documents AS (SELECT 1 AS doc_id, '{text}' AS text UNION ALL SELECT 2, NULL) " + plans.oracle_sql()["any_term_query"] + " ORDER BY doc_id").fetchall()
    assert got == [(1, " | ".join(["widow", "pension", *(f"term{c * 3}" for c in "abcdefghij")])), (2, "")]
