import datetime as dt

import pytest
from pyspark.sql import functions as F

from beaconloom.functions import addresses, dates, forms, maps, numbers, texts, urls


def apply(spark, function, rows, schema="a string"):
    names = [part.split()[0] for part in schema.split(",")]
    df = spark.createDataFrame([row if isinstance(row, tuple) else (row,) for row in rows], schema)
    return [r[0] for r in df.select(function(*[F.col(n) for n in names]).alias("out")).collect()]


def test_rounding(spark):
    texts_in = ["1.3", "1.7", "", "bad val", "2.5", "-2.5", "10.7", "10.3", ".5", "5.", "0.49999997"]
    assert apply(spark, numbers.rounded, texts_in) == [1, 2, None, None, 3, -3, 11, 10, 1, 5, 0]
    assert apply(spark, numbers.rounded, ["1e40", " 1.5", "1.5d", "NaN", "Infinity", "1\n", None]) == [None] * 7


def test_delta(spark):
    rows = {
        ("1700000000500", "1700000000613"): 113,
        ("", "5"): None,
        ("5", ""): None,
        (None, "5"): None,
        ("x", "5"): 5,
        (" 5", "9"): 9,
        ("9", "x"): 0,
        ("10", "5"): 0,
        ("0", "99999999"): 65535,
        ("0", "99999999999999999999"): 65535,
        ("-9", "9223372036854775807"): 0,
    }
    assert apply(spark, numbers.clamped_delta, list(rows), "a string, b string") == list(rows.values())


def test_whole_numbers_are_strict(spark):
    rows = {"5": 5, "+5": 5, "-5": -5, " 5": None, "5 ": None, "5\t": None, "\n5": None, "1.5": None}
    rows |= {"5\n": None, "": None, "x": None, "1e3": None, "99999999999999999999": None, "5.": None}
    assert apply(spark, numbers.whole, list(rows)) == list(rows.values())


def test_json_numbers(spark):
    good = ["0", "-0", "1.5", "1e5", "-2.5E-3", "", None]
    bad = ["01", "+1", ".5", "1.", "abc", " 1", "0,5", "NaN", "1\x01", "1\n"]
    check = lambda c: numbers.are_json_numbers_or_empty([c, F.lit("7"), F.lit("")])
    assert apply(spark, check, good) == [True] * len(good)
    assert apply(spark, check, bad) == [False] * len(bad)


URLS = {
    # url: (hostname, unreadable)
    "https://shop.example.com:8080/x?q": ("shop.example.com", False),
    "http://user:pw@h.com/": ("h.com", False),
    "http://a@b@c.com/": ("c.com", False),
    "http://[::1]:80/a": ("::1", False),
    "http//:shop.example.org/late": ("", False),
    "https://a_b.example.com:8080/x": ("a_b.example.com", False),
    "HTTPS://Mixed.Example.COM/": ("Mixed.Example.COM", False),
    "//cdn.example.org/y": ("cdn.example.org", False),
    "/only/a/path": ("", False),
    "mailto:x@example.com": ("", False),
    "http:///p": ("", False),
    "http://h/a b": ("h", False),
    "http://h/?%zz": ("h", False),
    "http://h:1:2/": ("h:1", False),
    "http://h:/": ("h", False),
    "http://h%25a/": ("h%a", False),
    "": ("", False),
    ":foo": (None, True),
    "1abc:foo": (None, True),
    "http://h:80a/": (None, True),
    "http://h/%zz": (None, True),
    "http://h/#%zz": (None, True),
    "x%zz": (None, True),
    "http://h a/": (None, True),
    "http://[::1/": (None, True),
    "http://[::1]x/": (None, True),
    "http://h\x01/": (None, True),
    "http://h%41/": (None, True),
    "http://us er@h/": (None, True),
}


def test_urls(spark):
    assert apply(spark, urls.is_bad_url, list(URLS)) == [bad for _, bad in URLS.values()]
    readable = {url: host for url, (host, bad) in URLS.items() if not bad}
    assert apply(spark, urls.hostname, list(readable)) == list(readable.values())
    assert apply(spark, urls.hostname, [None]) == [""]
    assert apply(spark, urls.archive_host, ["a.b.com"]) == ["a_b_com"]


def test_texts(spark):
    size = lambda c: F.concat_ws("|", *texts.screen_size(c))
    assert apply(spark, size, ["1536x864", "", "1x2x3", "7", None, "x"]) == [
        "1536|864",
        "|",
        "|",
        "|",
        "|",
        "|",
    ]
    headers = [' " BG " ', "BG", '""BG""', '"', "", None, 'a "', "Veliko Tarnovo"]
    assert apply(spark, texts.clean_header, headers) == [
        "BG",
        "BG",
        '"BG"',
        "",
        "",
        "",
        "a",
        "Veliko Tarnovo",
    ]
    kinds = {("", "xhr"): "xhr", ("", ""): "quit_page", (None, ""): "visit_page", (None, "spa"): "spa"}
    assert apply(spark, texts.event_type, list(kinds), "a string, b string") == list(kinds.values())
    versions = {("99", "1", "2345"): "99.1.2345", ("12", "", ""): "12", ("", "", ""): None}
    schema = "a string, b string, c string"
    assert apply(spark, texts.version_text, list(versions), schema) == list(versions.values())
    assert apply(spark, texts.first_address, ["1.2.3.4, 5.6.7.8", "", None]) == ["1.2.3.4", "", ""]
    days = [dt.datetime(2023, 9, 5, 7, 1), dt.datetime(2023, 12, 31, 23, 59)]
    assert apply(spark, texts.day_name, days, "a timestamp") == ["2023-9-5", "2023-12-31"]
    assert apply(spark, texts.hour_of, days, "a timestamp") == [7, 23]


def test_forms(spark):
    rows = {
        ("a=1&b=2&a=3", "c=4&a=9"): {"a": "1", "b": "2", "c": "4"},
        ("a+b=c%20d&&x", "=v"): {"a b": "c d", "x": "", "": "v"},
        (None, "u=http%3A%2F%2Fx%3Fa%3Db&k=a=b"): {"u": "http://x?a=b", "k": "a=b"},
        ("", ""): {},
        ("a=%zz&b=1", ""): None,
        ("a=%+f", ""): None,
        ("b=1", "a;c=1"): None,
    }
    assert apply(spark, forms.parse_form, list(rows), "a string, b string") == list(rows.values())
    with_headers = apply(
        spark, forms.parse_form, [("a=1", "", '{"H":["x"]}')], "a string, b string, c string"
    )
    assert with_headers == [{"a": "1", "request_headers": '{"H":["x"]}'}]


def test_form_is_decoded_once(spark):
    rows = spark.createDataFrame([("a=1&a=2", "b=3")], "a string, b string")
    plan = rows.select(forms.parse_form(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("UrlCodec.decode") == 2  # of keys and of values


def test_maps(spark):
    text = '{"User-Agent":["one","two"],"USER-AGENT":["three"],"Empty":[]}'
    lists = F.from_json(F.col("a"), "map<string,array<string>>")
    get = lambda name: apply(spark, lambda _: maps.header(maps.parse_headers(lists), name), [text])
    assert get("user-agent") == ["one"] and get("empty") == [""] and get("other") == [""]
    assert apply(spark, lambda _: maps.first_values(lists), [text])[0] == {
        "User-Agent": "one",
        "USER-AGENT": "three",
        "Empty": "",
    }
    line = apply(
        spark,
        lambda c: maps.sorted_json(F.create_map(F.lit("z"), c, F.lit("a.b"), F.lit(""))),
        ["<&>\"'\u2028é"],
    )
    assert line == ['{"a.b":"","z":"\\u003c\\u0026\\u003e\\"\'\\u2028é"}']


@pytest.mark.parametrize(
    "text, key",
    [
        ("203.0.113.9", "00000000000000000000ffffcb007109"),
        ("0.0.0.0", "00000000000000000000ffff00000000"),
        ("::ffff:203.0.113.9", "00000000000000000000ffffcb007109"),
        ("::1", "00000000000000000000000000000001"),
        ("::", "00000000000000000000000000000000"),
        ("2001:DB8::ff", "20010db80000000000000000000000ff"),
        ("1:2:3:4:5:6:7:8", "00010002000300040005000600070008"),
        ("1:2:3:4:5:6:7::", "00010002000300040005000600070000"),
        ("01.2.3.4", None),
        ("256.1.1.1", None),
        ("1.2.3", None),
        ("1:2:3:4:5:6:7", None),
        ("1::2::3", None),
        ("1:2:3:4:5:6:7:8::", None),
        (":::", None),
        ("fe80::1%eth0", None),
        ("12345::", None),
        ("", None),
        (None, None),
    ],
)
def test_address_keys(spark, text, key):
    assert apply(spark, addresses.ip_key, [text]) == [key]


def test_dates(spark):
    moments = [
        dt.datetime(2023, 11, 30, 10, 11, 12),
        dt.datetime(2023, 11, 29, 23, 59, 59),
        dt.datetime(2022, 8, 31),
        dt.datetime(2024, 1, 15, 1, 2, 3),
    ]
    assert apply(spark, dates.trial_end, moments, "a timestamp") == [
        dt.datetime(2024, 3, 1, 10, 11, 12),
        dt.datetime(2024, 2, 29, 23, 59, 59),
        dt.datetime(2022, 12, 1),
        dt.datetime(2024, 4, 15, 1, 2, 3),
    ]
    made = ["2022-08-27 05:53:00", "2022-08-27T05:53:00", "2022-13-27 05:53:00", "", None, "today"]
    assert apply(spark, dates.created_at, made) == [dt.datetime(2022, 8, 27, 5, 53)] + [None] * 5
    identifier = lambda c: dates.subscription_id(c, F.lit("r7"))
    assert apply(spark, identifier, moments[:1], "a timestamp") == ["2023-11-30|r7"]
    one, two = (apply(spark, lambda c: dates.subscription_id(c), moments[:1], "a timestamp") for _ in "ab")
    assert one != two and len(one[0]) == len("2023-11-30|") + 36
    hour = dt.timedelta(hours=1)
    pairs = [(moments[0], moments[0] - hour), (moments[0], moments[0]), (moments[0], moments[0] + hour)]
    assert apply(spark, dates.is_expired, pairs, "a timestamp, b timestamp") == [False, False, True]
