import pytest
from pyspark.sql import functions as F

from tideline.functions import redaction as R
from tideline.functions import text as T
from tideline.functions import vocabulary as V
from tideline.functions.requests import accepted, check_requests, slot_ok

WORDINGS = [
    ("Internet_Service", "FIBRE--optic please", "Fiber optic"),
    ("Internet_Service", "they have dsl at home", "DSL"),
    ("Internet_Service", "no", "No"),
    ("Internet_Service", "nothing", None),
    ("Contract", "a month_to_month deal", "Month-to-month"),
    ("Contract", "Two-Year", "Two year"),
    ("Contract", "two years", None),
    ("Payment_Method", "by credit card, automatic", "Credit card (automatic)"),
    ("Payment_Method", "e-check", "Electronic check"),
    ("gender", "a female customer", "Female"),
    ("gender", "M", "Male"),
    ("Tech_Support", "never, not subscribed", "No"),
    ("Tech_Support", "subscribed", "Yes"),
    ("Tech_Support", "yes or no", None),
    ("Streaming_TV", "has no internet service at all", "No internet service"),
    ("Dual", "No Phone Service!", "No phone service"),
    # two words are no single no-word, so the age flag reads only "subscribed"
    ("Senior_Citizen", "not subscribed", "Yes"),
    ("Senior_Citizen", "no internet service", "No"),
    ("tenure", "roughly 18 months", "18"),
    ("tenure", "1,200 days", "1"),
    ("Monthly_Charges", "EUR 19.90/mo", "19.90"),
    ("Total_Charges", "unknown", None),
]


def test_wordings_fold_onto_the_vocabulary(spark):
    df = spark.createDataFrame(WORDINGS, "feature string, value string, expected string")
    wrong = T.canonicalize(df).where(~F.col("canonical").eqNullSafe(F.col("expected"))).collect()
    assert wrong == []


@pytest.mark.parametrize(
    ("value", "text", "expected"),
    [
        ("18", "with us 18 months", True),
        ("19.9", "pays 19.90", True),
        ("1200", "1,200 in total", True),
        ("0", "pays 10", False),
        ("0", "no digits at all", False),
        ("1.2", "version 1.2.3", False),
        ("weeks", "weeks 5", False),
    ],
)
def test_a_number_must_be_in_the_users_text(spark, value, text, expected):
    df = spark.createDataFrame([(value, text)], "v string, t string")
    assert df.select(T.grounded_number(F.col("v"), F.col("t"))).first()[0] is expected


REQUESTS = [
    ('{"target_features":["tenure"],"filters":{"tenure":"5"},"out_of_scope":false}', "", ""),
    ('{"filters":{"Contract":"x"}}', "", "bad_flag"),
    ("{}", "", "bad_flag"),
    ('{"out_of_scope":1}', "bad_flag", "bad_flag"),
    ('{"out_of_scope":null}', "bad_flag", "bad_flag"),
    ('{"score":0.4,"out_of_scope":true}', "unknown_key", "unknown_key"),
    ('{"filters":{"tenure":5},"out_of_scope":true}', "bad_filter_value", ""),
    ('{"filters":{"tenure":null},"out_of_scope":true}', "bad_filter_value", ""),
    ('{"filters":{"Colour":"red"},"out_of_scope":true}', "bad_filter_name", ""),
    ('{"filters":[],"out_of_scope":true}', "bad_filters", ""),
    ('{"target_features":["Colour"],"out_of_scope":true}', "bad_target", ""),
    ('{"target_features":"tenure","out_of_scope":true}', "bad_target", ""),
    ('{"target_features":[3],"out_of_scope":true}', "bad_target", ""),
    ("[1]", "not_object", "not_object"),
    ("null", "not_object", "not_object"),
    ("{", "not_json", "not_json"),
    (None, "not_json", "not_json"),
]


def test_requests_are_judged_strictly(spark):
    df = spark.createDataFrame(REQUESTS, "c string, reason_x string, envelope_x string")
    rows = check_requests(df, "c").withColumn("accepted", accepted()).collect()
    assert [(r.c, r.reason, r.envelope) for r in rows] == REQUESTS
    assert [bool(r.accepted) for r in rows].count(True) == 1
    assert rows[0].targets == ["tenure"] and rows[0].filters == {"tenure": "5"}
    assert rows[1].out_of_scope is False


def test_vocabulary_is_closed():
    assert len(V.FEATURES) == len(set(V.FEATURES)) == 19
    assert set(V.MENUS) == set(V.CATEGORICAL_FEATURES)
    assert V.ROW_KEY not in V.FEATURES and V.LABEL not in V.FEATURES
    for name, wordings in V.WORDINGS.items():
        assert {canonical for _, canonical in wordings} <= set(V.MENUS[name])


def test_slots_take_plain_numbers_and_menu_values(spark):
    cases = [
        ("tenure", "12", True), ("tenure", "12.", False), ("tenure", "-1", False),
        ("Contract", "One year", True), ("Contract", "one year", False), ("Other", "1", False),
    ]
    df = spark.createDataFrame(cases, "f string, v string, x boolean")
    assert df.where(slot_ok(F.col("f"), F.col("v")) != F.col("x")).isEmpty()


def test_personal_data_is_scrubbed(spark):
    df = spark.createDataFrame(
        [
            ("write ann.lee@mail.org or ring +44 20 7946 0958 now",),
            ("id 1234ABCDE and 1234-ABCDE",),
            ("order-5551234567 stays, 12345 too",),
            ("plain",),
            (None,),
        ],
        "t string",
    )
    found = [tuple(r) for r in df.select(R.redact(F.col("t")), R.redact(F.col("t"), strict=False)).collect()]
    assert found[0][0] == "write [EMAIL] or ring [PHONE] now"
    assert found[1] == ("id [CUSTOMER_ID] and 1234-ABCDE", "id [CUSTOMER_ID] and [CUSTOMER_ID]")
    assert found[2][0] == "order-5551234567 stays, 12345 too"
    assert found[3][0] == "plain" and found[4][0] is None


def test_maps_are_scrubbed_and_keys_stay_unique(spark):
    df = spark.sql("select map('a@b.org', 'x', 'c@d.org', 'call 0123456789', 'k', 'v') as m")
    assert df.select(R.redact_map(F.col("m"))).first()[0] == {"[EMAIL]": "call [PHONE]", "k": "v"}


def test_maps_are_scrubbed_once(spark):
    """The entries are compared with each other, but scrubbed in one place of the plan."""
    df = spark.sql("select map('a@b.org', k, 'b@c.org', 'x', k, null) as m from values ('k'), ('0123456789') as t(k)")
    out = df.select(R.redact_map(F.col("m")).alias("m"))
    plan = out._jdf.queryExecution().analyzed().toString()
    once = df.select(F.transform(F.map_entries("m"), lambda e: F.struct(R.redact(e["key"]), R.redact(e["value"]))).alias("m"))
    assert plan.count(R.MARK_PHONE) == once._jdf.queryExecution().analyzed().toString().count(R.MARK_PHONE)
    assert [r.m for r in out.collect()] == [{"[EMAIL]": "x", "k": None}, {"[EMAIL]": "x", "[PHONE]": None}]
    none = spark.sql("select cast(null as map<string,string>) as m").select(R.redact_map(F.col("m"))).first()[0]
    assert none is None


def test_urls_and_keys(spark):
    df = spark.createDataFrame([("https://h.example/a/b?mail=x@y.zz#f", "s3cret", "1.2.3.4")], "u string, t string, h string")
    path, by_token, by_host = df.select(
        R.url_path_only(F.col("u")),
        R.key_digest(F.col("t"), F.col("h")),
        R.key_digest(F.lit(None).cast("string"), F.col("h")),
    ).first()
    assert path == "/a/b" and by_host == "addr:1.2.3.4"
    assert by_token.startswith("token:") and len(by_token) == 22 and "s3cret" not in by_token
