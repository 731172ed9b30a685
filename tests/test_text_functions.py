"""Text functions against plain Python on literals and random strings."""

import random
import re
import unicodedata

from provena.functions import text as T
from pyspark.sql import functions as F


def run(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, c {kind}")
    return [r["x"] for r in df.select("i", f(F.col("c")).alias("x")).orderBy("i").collect()]


ALPHABET = list("ab و ـأإآؤئةىًّٰٕۖؐ  \t\n\x1c.,،؛()-–12٣٤") + ["محمد", "بن", " "]


def randoms(seed, n=300):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_normalize_arabic(spark):
    def plain(s):
        s = re.sub(r"\s+", " ", s.strip())
        s = s.replace("ـ", "")
        return s.translate(str.maketrans("أإآؤئ", "اااوي"))

    values = randoms(1)
    assert run(spark, values, T.normalize_arabic) == [plain(v) for v in values]
    assert run(spark, ["أبو  بكر", "محمـــد بن إبراهيم", "  سفيان  ", "مؤمن", None], T.normalize_arabic) == ["ابو بكر", "محمد بن ابراهيم", "سفيان", "مومن", ""]
    assert run(spark, ["مُحَمَّد"], T.normalize_for_search) == ["محمد"]


def test_normalize_name(spark):
    wide = re.compile("[ؐ-ًؚ-ٰٟۖ-ۜ۟-۪ۤۧۨ-ۭ]")

    def plain(s):
        s = "".join(c for c in wide.sub("", s) if unicodedata.category(c) != "Mn")
        s = re.sub(r"\(.*?\)", "", s)
        s = re.sub(r"""[.,،؛;:؟?!"'«»\-_/\\]""", "", s)
        s = s.translate(str.maketrans("أإآئؤةى", "ااايوهي"))
        s = re.sub(r"^و\s*", "", s)
        return re.sub(r"\s+", " ", s).strip()

    values = randoms(2)
    assert run(spark, values, T.normalize_name) == [plain(v) for v in values]
    assert run(spark, ["عَائِشَةَ", "الزهري (١)", "وعائشة", "يحيى"], T.normalize_name) == ["عايشه", "الزهري", "عايشه", "يحيي"]


def test_clean_person_name(spark):
    got = run(spark, ["حدثنا  عبد الله رضي الله عنه وغيره", "عن  قال سفيان", "أم سلمة أم المؤمنين", None], T.clean_person_name)
    assert got == ["عبد الله", "سفيان", "أم سلمة", ""]


def test_numbers(spark):
    values = ["٧٥٣٦ - حَدَّثَنِي", "12 - a", "none", None, "99999999999999 - x"]
    assert run(spark, values, T.extract_number) == [7536, 12, None, None, None]
    assert run(spark, values, T.arabic_index) == [7536, None, None, None, None]
    assert run(spark, values[:3], T.strip_number) == ["حَدَّثَنِي", "a", "none"]
    assert run(spark, ["٢٧٢ - … ٢٧٣ - …", "8 (x) - y 9000 - z", "nothing"], lambda c: T.all_indices(c, F.lit(5), most=7563)) == [[272, 273], [8], [5]]
    assert run(spark, ["8 (x) - y 9000 - z", "nothing", None], T.all_indices) == [[8, 9000], [], []]
    assert run(spark, ["https://h/book/1681/10961", "/book/x"], T.section_id) == [10961, None]


def test_small_functions(spark):
    assert run(spark, [": : a:b", "", None], T.strip_leading) == ["a:b", "", ""]
    assert run(spark, ["a ،:"], T.trim_name_tail) == ["a "]
    assert run(spark, ["k：", "  a  b: "], T.clean_key) == ["k", "a b"]
    assert run(spark, ["a\n a \n\nb\na"], T.dedup_lines) == ["a\nb\na"]
    assert run(spark, ["/x", "http://y"], lambda c: T.absolute_url(c, "http://h/")) == ["http://h/x", "http://y"]
    assert run(spark, ["١٢ - حدثنا سفيان", "12", "a b"], T.first_word) == ["حدثنا", None, "a"]
    assert run(spark, ["سفيان", "النبي", "عبد الله", "عبد الرحمن بن عوف", "زيد", ""], T.is_ambiguous) == [True, False, True, False, True, False]
    assert run(spark, ["سفيان الثوري"], T.person_hash_id) == ["NAR_6B2D4138DA18"]
    assert run(spark, ["a b c", "a"], lambda c: T.token_prefixes(F.split(c, " "))) == [["a b", "a"], []]
    assert run(spark, ["x" * 300], T.preview) == ["x" * 200 + "..."]
    assert run(spark, ["o'b\"c\\"], lambda c: T.escape_quotes(c, True)) == ["o\\'b\\\"c\\\\"]
    assert run(spark, ['{"a":{"href":"u"},"href" : "v"}'], T.hrefs) == [["u", "v"]]
    assert run(spark, ["م" * 21, "abc"], T.is_arabic_heavy) == [True, False]
    assert run(spark, ["/people/3 /people/4 /people/3"], T.url_ids) == [["3", "4"]]


def test_iso_timestamps(spark):
    df = spark.sql("SELECT timestamp'2024-03-01 05:06:07.9' AS t")
    assert df.select(T.iso_utc("t")).first()[0] == "2024-03-01T05:06:07Z"
    assert df.select(T.iso_utc(F.lit(None).cast("timestamp"))).first()[0] is None
