"""Persian text, numbers and phonemes: native functions against the oracle.

The tables hold no Persian text, so inputs are numbers of the tables and the literal rows below.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import g2p, numbers, persian, phonemes
from ..functions.dialect import Dialect, catalogue
from ..functions.persian import ZWNJ

PHRASES = (
    "سلام، دنیا! حال شما چطور است؟", "كتاب هاي خوب را مي خوانم.", "مثلاً این جمله", "قیمت ۵۰۰۰ت است…", f"می{ZWNJ}روم به خانه؛ شما؟", "٪۴۵ از مردم", "مَدرَسه بُزُرگ", "abc و ۱۲۳", "", "«نقل قول» (پرانتز): پایان.",
)
ENTITIES = ("1403/5/12", "2024-03-15", "1403/19/12", "14:30:15", "از 9:00 تا 11:00", "45%", "٪۴۵", "۵۰۰۰ت", "1,000 تومان", "021-88776655", "09121234567", "1000-2000", "-5", "3/4", "3.14", "۳م", "20ام", "12 km/h", "5kg", "1٬234٬567", "2٫5", "0", "1234567890123", "متن بی عدد")
PHONEMES = ("salAm", "ketAb-e xub", "mi1ravam||", "che?", "zhAle|shab!", "bozorg", "xAne", "dustdAr", "'emruz", "w%q", "")


def rows(values) -> str:
    """id, s: literal strings."""
    quoted = ", ".join("({}, {})".format(i, " || chr(39) || ".join("'" + p + "'" for p in v.split("'"))) for i, v in enumerate(values))
    return f"SELECT * FROM (VALUES {quoted}) v(id, s)"


def integers(d: Dialect) -> str:
    """n: integers of many sizes from the tables."""
    return f"SELECT l_orderkey, l_linenumber, {d.long('l_orderkey * CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 1000 WHEN 3 THEN 999983 WHEN 4 THEN 1000000007 WHEN 5 THEN -17 ELSE 1000000000039 END')} AS n FROM {d.t('lineitem')}"


def sizes(d: Dialect) -> str:
    return f"SELECT p_partkey, {d.long('p_size')} AS n, {d.long('p_partkey % 131 + 1')} AS m FROM {d.t('part')}"


def _date_words(d: Dialect) -> str:
    months = d.array(*(f"'{m}'" for m in numbers.GREGORIAN))
    day = "CAST(substring(day, 9, 2) AS BIGINT)"
    return f"""
        SELECT o_orderkey, concat({numbers.ordinal_of(d, 'day_words', day)}, ' ', {d.at(months, 'CAST(substring(day, 6, 2) AS INT)')}, ' ', {numbers.int_words(d, 'CAST(substring(day, 1, 4) AS BIGINT)')}) AS words
        FROM (SELECT o_orderkey, day, {numbers.int_words(d, day)} AS day_words FROM (SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS day FROM {d.t('orders')}) o) w"""


def _time_words(d: Dialect) -> str:
    return f"""
        SELECT event_id, concat('{numbers.HOUR} ', {numbers.int_words(d, 'h')}, CASE WHEN m > 0 THEN concat('{numbers.AND}', {numbers.int_words(d, 'm')}, ' {numbers.MINUTE}') ELSE '' END) AS words
        FROM (SELECT event_id, {d.long('event_id % 24')} AS h, {d.long('event_id % 60')} AS m FROM {d.t('events')}) e"""


TEXTS = {
    # T1 (without NFC) T4 T8 T19
    "char_unify": lambda d: f"SELECT id, {persian.unify(d, 's')} AS unified, {persian.tanwin(d, 's')} AS tanwin, trim(s) AS trimmed FROM ({rows(PHRASES)}) p",
    "drop_unsupported": lambda d: f"SELECT id, {d.sub('s', '[^ء-ی،؛؟!.:()«»‌ ]', ' ')} AS kept FROM ({rows(PHRASES)}) p",
    # T2 T5
    "digits_ascii": lambda d: f"SELECT id, {persian.digits(d, 's')} AS ascii_digits FROM ({rows(PHRASES)}) p",
    "strip_marks": lambda d: f"SELECT id, {persian.strip_marks(d, 's')} AS bare FROM ({rows(PHRASES)}) p",
    # T14 T16 G26
    "tokens": lambda d: f"SELECT id, {d.join(persian.tokens(d, 's'), '/')} AS tokens, {d.size(persian.tokens(d, 's'))} AS n FROM ({rows(PHRASES)}) p",
    "break_map": lambda d: f"SELECT id, {d.join(d.keep(d.map(persian.tokens(d, 's'), 't', persian.break_symbol(d, 't')), 'b', 'b IS NOT NULL'), ' ')} AS breaks FROM ({rows(PHRASES)}) p",
    # T18
    "timeout_minutes": lambda d: f"SELECT id, round({persian.timeout_minutes(d, 's')}, 6) AS minutes FROM ({rows(('30m', '2h', '90s', '1d', '45', '1.5h'))}) p",
    # G1
    "key_normalise": lambda d: f"SELECT id, {persian.key(d, 's')} AS word_key FROM ({rows(PHRASES)}) p",
    # N1 N2 N3 N5 N6 N7
    "number_words": lambda d: f"SELECT l_orderkey, l_linenumber, n, {numbers.int_words(d, 'n')} AS words FROM ({integers(d)}) i",
    "ordinal_words": lambda d: f"SELECT p_partkey, {numbers.ordinal_of(d, 'm_words', 'm')} AS words FROM (SELECT *, {numbers.int_words(d, 'm')} AS m_words FROM ({sizes(d)}) z) y",
    "fraction_words": lambda d: f"SELECT p_partkey, concat({numbers.int_words(d, 'n')}, ' ', {numbers.ordinal_of(d, 'm_words', 'm')}) AS words FROM (SELECT *, {numbers.int_words(d, 'm')} AS m_words FROM ({sizes(d)}) z) y",
    "digit_reading": lambda d: f"SELECT l_orderkey, l_linenumber, n, {numbers.read_digits(d, 'CAST(n AS VARCHAR(30))')} AS words FROM ({integers(d)}) i",
    # N4
    "decimal_words": lambda d: f"SELECT p_partkey, {numbers.decimal_words(d, 'whole', 'part')} AS words FROM (SELECT p_partkey, CAST(p_size AS VARCHAR(9)) AS whole, CAST(p_partkey * 7 % 1000 AS VARCHAR(9)) AS part FROM {d.t('part')}) z",
    # A leading zero is an identifier
    "numeric_token_words": lambda d: f"SELECT p_partkey, CASE WHEN token LIKE '0_%' THEN {numbers.read_digits(d, 'token')} ELSE {numbers.int_words(d, 'CAST(token AS BIGINT)')} END AS words FROM (SELECT p_partkey, concat(CASE WHEN p_partkey % 3 = 0 THEN '0' ELSE '' END, CAST(p_size AS VARCHAR(9))) AS token FROM {d.t('part')}) z",
    # N10 N11
    "date_words": _date_words,
    "time_words": _time_words,
    # N12 N13 N14
    "percent_currency_unit_words": lambda d: f"SELECT p_partkey, concat({numbers.int_words(d, 'n')}, ' ', CASE p_partkey % 3 WHEN 0 THEN '{numbers.PERCENT}' WHEN 1 THEN '{numbers.CURRENCIES['ت']}' ELSE '{numbers.UNITS['kg']}' END) AS words FROM ({sizes(d)}) z",
    # N15 N16
    "identifier_reading": lambda d: f"SELECT c_custkey, {numbers.read_digits(d, 'phone')} AS words FROM (SELECT c_custkey, concat('021-', CAST(88000000 + c_custkey AS VARCHAR(12))) AS phone FROM {d.t('customer')}) c",
    # N17
    "range_words": lambda d: f"SELECT p_partkey, concat({numbers.int_words(d, 'n')}, ' {numbers.UPTO} ', {numbers.int_words(d, 'm')}) AS words FROM ({sizes(d)}) z",
    # G17-G21 J12 J13
    "phoneme_tokens": lambda d: f"SELECT id, {d.join(phonemes.tokens(d, 's'), '/')} AS symbols FROM ({rows(PHONEMES)}) p",
    "phoneme_ids": lambda d: f"SELECT id, {d.join(d.map(phonemes.ids(d, phonemes.tokens(d, 's')), 'i', 'CAST(i AS VARCHAR(9))'), ' ')} AS ids, {phonemes.text_of(d, phonemes.ids(d, phonemes.tokens(d, 's')))} AS back FROM ({rows(PHONEMES)}) p",
    "intersperse": lambda d: f"SELECT id, {d.join(d.map(phonemes.encoded(d, 's'), 'i', 'CAST(i AS VARCHAR(9))'), ' ')} AS encoded FROM ({rows(PHONEMES)}) p",
    # G9 G10 G19 G26
    "ezafe_linker": lambda d: f"SELECT id, {phonemes.linker(d, 's')} AS linked FROM ({rows(PHONEMES)}) p",
    "stress_insert": lambda d: f"SELECT id, {phonemes.stressed(d, 's', 'id % 3')} AS stressed, {phonemes.vowels(d, 's')} AS vowels FROM ({rows(PHONEMES)}) p",
    # G4
    "sonority_pairs": lambda d: "SELECT a.s AS first_c, b.s AS second_c, a.level > b.level AS falling FROM " + " CROSS JOIN ".join("(SELECT * FROM (VALUES " + ", ".join(f"('{s}', {v})" for s, v in phonemes.SONORITY.items() if s != "'") + f") v(s, level)) {t}" for t in "ab"),
}

SENTENCES = ("کتاب من روی میز است", "مرد را دید", "او دیروز مرد", "این کتاب خوب", "ساعت نه صبح", "نه شما", "پر از گل", "علی به تهران رفت", "گندم را کشت", "کشت گندم", "مهر کرد", "مهر ماه", "در تنگ آب", "جای تنگ", "کرم من", "کرم پوست", "کرم خاکی")


def classes() -> str:
    """w, tag, place: word classes in order of precedence."""
    cells = [f"('{w}', '{tag}', {i})" for i, (tag, words) in enumerate(g2p.CLASSES.items()) for w in words.split()]
    return f"SELECT * FROM (VALUES {', '.join(cells)}) c(w, tag, place)"


def placed(d: Dialect) -> str:
    """id, pos, w: the words of the sentences in order."""
    if d.spark:
        return f"SELECT id, pos, w FROM ({rows(SENTENCES)}) s LATERAL VIEW posexplode(split(s, ' ')) x AS pos, w"
    return f"SELECT id, CAST(pos - 1 AS INT) AS pos, w FROM (SELECT id, unnest(string_split(s, ' ')) AS w, generate_subscripts(string_split(s, ' '), 1) AS pos FROM ({rows(SENTENCES)}) s) x"


def _readings() -> str:
    """The table of homographs as one expression over w, before and after."""
    tests = {".": lambda _: "after IS NULL", "-": lambda _: "false", "": lambda _: "true"}
    among = lambda place: lambda words: f"coalesce({place} IN ({', '.join(repr(x) for x in words.split())}), false)"
    tests |= {place: among(place) for place in ("before", "after")}
    return "CASE " + " ".join(f"WHEN w = '{w}' AND {tests[place](words)} THEN '{reading}'" for w, place, words, reading in g2p.HOMOGRAPHS) + " END"


TEXTS |= {
    # Ordered membership, noun where no class holds the word
    "word_class_tags": lambda d: f"""
        SELECT id, pos, w, coalesce(tag, 'noun') AS tag FROM (
            SELECT p.id, p.pos, p.w, c.tag, row_number() OVER (PARTITION BY p.id, p.pos ORDER BY c.place) AS k FROM ({placed(d)}) p LEFT JOIN ({classes()}) c ON p.w = c.w) t WHERE k = 1""",
    # Every homograph by the words around it (no linkers here)
    "homograph_context": lambda d: f"""
        SELECT id, pos, w, {_readings()} AS reading
        FROM (SELECT id, pos, w, lag(w) OVER s AS before, lead(w) OVER s AS after FROM ({placed(d)}) p WINDOW s AS (PARTITION BY id ORDER BY pos)) c WHERE w IN ({', '.join(sorted({f"'{h[0]}'" for h in g2p.HOMOGRAPHS}))})""",
    # Marks that a text carries before they are stripped
    "mark_flags": lambda d: f"""
        SELECT id, length(u) AS n_chars, {d.has('u', persian.DIACRITICS)} AS has_diacritics, {d.has('u', persian.TANWIN)} AS has_tanwin, {d.has('u', '[0-9]')} AS has_digit, {d.has('u', '[A-Za-z]')} AS has_latin, {d.has('u', ZWNJ)} AS has_zwnj
        FROM (SELECT id, {persian.digits(d, persian.unify(d, 's'))} AS u FROM ({rows(PHRASES)}) p) t""",
    # Two arrays by place
    "positional_zip": lambda d: f"""
        SELECT id, z.w AS w, z.n AS n FROM (SELECT id, {"explode(transform(arrays_zip(ws, ns), x -> named_struct('w', x.ws, 'n', x.ns)))" if d.spark else "unnest(list_transform(list_zip(ws, ns), lambda x: {'w': x[1], 'n': x[2]}))"} AS z
        FROM (SELECT id, {d.split('s', ' ')} AS ws, {d.map(d.split('s', ' '), 'x', 'CAST(length(x) AS BIGINT)')} AS ns FROM ({rows(SENTENCES)}) p) a) b""",
    # Symbols and ids side by side
    "id_lookup": lambda d: f"SELECT p.s AS symbol, {phonemes.UNKNOWN + 0} AS unknown_id, coalesce(i.id, {phonemes.UNKNOWN}) AS symbol_id FROM ({rows(('sh', 'A', 'zz', '1', 'x', '@'))}) p LEFT JOIN ({rows(phonemes.SYMBOLS)}) i ON p.s = i.s",
}

QUERIES, ORACLE = catalogue(TEXTS)


def expand_numbers(spark, sf_dir: str):
    """Entities in running text, by the ordered scanner (rows only)."""
    return spark.sql(rows(ENTITIES)).withColumn("words", numbers.expand_numbers(F.col("s")))


def normalise_text(spark, sf_dir: str):
    """The whole order, with numbers spelled (rows only)."""
    return spark.sql(rows(PHRASES)).select("id", persian.normalised(F.col("s")).alias("normal"))


def fold_marks(spark, sf_dir: str):
    """T3 (rows only: look-around)."""
    return spark.sql(rows(ENTITIES)).select("id", F.expr(persian.fold_marks("s")).alias("folded"))


QUERIES |= {"expand_numbers": expand_numbers, "normalise_text": normalise_text, "fold_marks": fold_marks}

# What the entities and phrases read as, written out: the oracle of the steps that SQL has no patterns for.
SPELLED = (
    "دوازدهم مرداد هزار و چهارصد و سه", "پانزدهم مارس دو هزار و بیست و چهار", "هزار و چهارصد و سه/نوزده دوازدهم", "ساعت چهارده و سی دقیقه و پانزده ثانیه", "از ساعت نه تا یازده", "چهل و پنج درصد", "چهل و پنج درصد",
    "پنج هزار تومان", "هزار تومان", "صفر دو یک هشت هشت هفت هفت شش شش پنج پنج", "صفر نه یک دو یک دو سه چهار پنج شش هفت", "هزار تا دو هزار", "منفی پنج", "سه چهارم", "سه ممیز چهارده صدم", "سوم", "بیستم", "دوازده کیلومتر بر ساعت",
    "پنج کیلوگرم", "یک میلیون و دویست و سی و چهار هزار و پانصد و شصت و هفت", "دو ممیز پنج دهم", "صفر", "یک دو سه چهار پنج شش هفت هشت نه صفر یک دو سه", "متن بی عدد",
)
NORMAL = (
    "سلام، دنیا! حال شما چطور است؟", f"کتاب{ZWNJ}های خوب را می{ZWNJ}خوانم.", "مثلان این جمله", "قیمت پنج هزار تومان است.", f"می{ZWNJ}روم به خانه؛ شما؟", "چهل و پنج درصد از مردم", "مدرسه بزرگ", "و صد و بیست و سه", "", "«نقل قول» (پرانتز): پایان.",
)
FOLDED = tuple({"1,000 تومان": "1000 تومان", "1٬234٬567": "1234567", "2٫5": "2.5"}.get(e, e) for e in ENTITIES)
ORACLE |= {
    "expand_numbers": f"SELECT e.id, e.s, w.s AS words FROM ({rows(ENTITIES)}) e JOIN ({rows(SPELLED)}) w USING (id)",
    "normalise_text": f"SELECT id, s AS normal FROM ({rows(NORMAL)}) n",
    "fold_marks": f"SELECT id, s AS folded FROM ({rows(FOLDED)}) f",
}
