"""Column expressions over narrative text, dates, folios and vocabulary terms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Spellings of the months in the sources.
MONTHS = {
    "gennaio": "01", "febbraio": "02", "marzo": "03", "aprile": "04", "maggio": "05", "giugno": "06",
    "luglio": "07", "agosto": "08", "settembre": "09", "ottobre": "10", "novembre": "11", "dicembre": "12",
    "gennaro": "01", "genaio": "01", "febbraro": "02", "febbario": "02", "febraio": "02", "magio": "05",
    "giungo": "06", "giguno": "06", "agostro": "08", "ettembre": "09", "otobre": "10", "novembe": "11",
    "november": "11", "decembre": "12",
}
#: Words that don't tell acts apart.
STOPWORDS = "alla allo come con dalla dalle degli della delle detta dette detti detto dice essere firenze gli il in la le lo nel nella per ragione signor signora signori societa società sotto una".split()
#: Words that vocabulary signatures leave out.
ACTIVITY_STOP = "di d de del della dello dei delle degli e et ed al la il lo con in".split()
TITLE_STOP = "e et ed il lo la i di de del l".split()
#: Letters with a plain form, for folding accents without leaving the JVM.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyyAAAAAACEEEEIIIINOOOOOUUUUY"

DAY = r"\b([0-3]?\d)\s+([A-Za-zàèéìòù]+)\s+(1[4-8]\d{2})(?:/(\d{2}))?\b"


def _month(name: Column) -> Column:
    return F.create_map(*[F.lit(x) for kv in MONTHS.items() for x in kv])[F.lower(name)]


def _is_day(day: Column) -> Column:
    return day.cast("int").between(1, 31)


def italian_date(c: Column) -> Column:
    """ISO text of the first day-month-year in c; null if its month or day is none."""
    day, month, year = (F.regexp_extract(c, DAY, k) for k in (1, 2, 3))
    good = F.when(day == "", None).when(_is_day(F.when(day != "", day)) & _month(month).isNotNull(), F.concat_ws("-", year, _month(month), F.lpad(day, 2, "0")))
    return good


def italian_dates(c: Column) -> Column:
    """All dates in c, sorted; a year such as 1694/95 gives both readings."""
    found = F.regexp_extract_all(c, F.lit(DAY), F.lit(0))

    def read(m: Column) -> Column:
        day, month, year, short = (F.regexp_extract(m, DAY, k) for k in (1, 2, 3, 4))
        end = F.concat(F.lit("-"), _month(month), F.lit("-"), F.lpad(day, 2, "0"))
        dates = F.array(F.concat(year, end), F.when(short != "", F.concat(F.substring(year, 1, 2), short, end)))
        return F.when(_is_day(day) & _month(month).isNotNull(), dates).otherwise(F.array().cast("array<string>"))

    return F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform(found, read)), lambda x: x.isNotNull())))


def stile_fiorentino(iso: Column) -> Column:
    """The modern date of an ISO date that counts years from 25 March; null where no shift applies."""
    year, rest = F.substring(iso, 1, 4).cast("int"), F.substring(iso, 6, 5)
    return F.when((year < 1750) & (rest <= "03-24"), F.concat_ws("-", (year + 1).cast("string"), rest))


def match_text(c: Column) -> Column:
    """Lower case, marks <...> and punctuation as spaces, white space collapsed."""
    c = F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "<[^>]+>", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w]+", " "), r"(?U)\s+", " "))


def match_tokens(c: Column) -> Column:
    """Words of match_text longer than two letters, without stopwords and numbers."""
    return F.filter(F.split(match_text(c), " "), lambda w: (F.length(w) > 2) & ~w.isin(*STOPWORDS) & ~w.rlike(r"^\d+$"))


def phrase_in(text: Column, phrase: Column) -> Column:
    """Whether the folded text holds the folded phrase of at least four characters."""
    p = match_text(phrase)
    return (F.length(p) >= 4) & F.contains(match_text(text), p)


def number_in(text: Column, number: Column) -> Column:
    """Whether the number's digits stand among all digits of the text."""
    digits = F.regexp_replace(number.cast("string"), r"\D", "")
    return (digits != "") & F.contains(F.regexp_replace(text, r"\D", ""), digits)


def fold_accents(c: Column) -> Column:
    return F.translate(c, ACCENTED, PLAIN)


def lookup_key(c: Column) -> Column:
    """Accents, case and runs of white space folded."""
    return F.trim(F.regexp_replace(F.lower(fold_accents(c)), r"\s+", " "))


def _words(c: Column, stop: list[str]) -> Column:
    return F.filter(F.split(c, " +"), lambda w: (w != "") & ~w.isin(*stop))


def activity_signature(c: Column) -> Column:
    """Sorted words of an activity with its spelling folded; words themselves are never merged."""
    s = F.regexp_replace(fold_accents(F.lower(c)), "[’`´]", "'")
    s = F.regexp_replace(F.regexp_replace(s, r"\bd'", " "), "[^a-z ]", " ")
    s = F.regexp_replace(F.replace(F.replace(s, F.lit("x"), F.lit("s")), F.lit("qu"), F.lit("cu")), "ti(?=[aeou])", "zi")
    return F.array_join(F.array_sort(_words(F.regexp_replace(s, r"(.)\1", "$1"), ACTIVITY_STOP)), " ")


def title_signature(c: Column) -> Column:
    """Sorted words of a title; a last e of words longer than three letters is dropped."""
    s = F.replace(F.regexp_replace(fold_accents(F.lower(c)), "[^a-z ]", " "), F.lit("chiar"), F.lit("clar"))
    words = _words(F.regexp_replace(s, r"\bhuomo\b", "uomo"), TITLE_STOP)
    return F.array_join(F.array_sort(F.transform(words, lambda w: F.when((F.length(w) > 3) & w.endswith("e"), F.regexp_replace(w, "e$", "")).otherwise(w))), " ")


def place_signature(c: Column) -> Column:
    """Accents, case and punctuation folded, every word kept."""
    s = F.regexp_replace(fold_accents(F.lower(c)), "[’`´]", "'")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"\s*,\s*", ", "), r"\s+", " "), "^[ .,]+|[ .,]+$", "")


def folio_key(c: Column) -> Column:
    """Sortable (number, bis, letter in brackets, side) of a folio such as 142bisv or 171(a)r."""
    pattern = r"^\s*(?:cc?\.\s*)?(\d+)(bis)?(?:\(([^)]*)\))?\s*([rv])?"
    part = [F.regexp_extract(c, pattern, k) for k in (1, 2, 3, 4)]
    return F.struct(F.when(part[0] != "", part[0]).cast("int"), F.when(part[1] != "", 1).otherwise(0), part[2], F.when(part[3] == "v", 1).otherwise(0))


def content_key(*columns: str) -> Column:
    """Twelve hex digits that depend on the content alone."""
    return F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns)), 256), 1, 12)


FOLIO = r"^(\d+(?:bis|\([^)]*\))?|n\.n)([rv])?(?:[-–](\d+(?:bis|\([^)]*\))?)?([rv])?)?$"


def db_folio(c: Column) -> Column:
    """(start, end) of a folio as the archive's rows give it: notes in square brackets and what follows / or = are
    dropped, 24rv is 24r to 24v, 118v-r ends on its own number; what is none of these stays as it is."""
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"\[[^\]]*\]", ""), "[/=].*$", ""), r"\s+", "")
    both = F.regexp_extract(bare, r"(?i)^(\d+(?:bis)?)(?:rv|vr)$", 1)
    part = [F.regexp_extract(F.lower(bare), FOLIO, k) for k in (1, 2, 3, 4)]
    start = F.concat(part[0], part[1])
    other = F.concat(F.when(part[2] != "", part[2]).otherwise(part[0]), part[3])
    end = F.when((part[2] != "") | (part[3] != ""), other).otherwise(start)
    known = part[0] != ""
    first = F.when(both != "", F.concat(both, F.lit("r"))).when(known, start).when(bare != "", bare)
    return F.struct(first.alias("start"), F.when(both != "", F.concat(both, F.lit("v"))).when(known, end).otherwise(first).alias("end"))


def folio_relation(start: Column, end: Column, other: Column, other_end: Column) -> Column:
    """How two spans of folios stand to each other: missing, exact, within, overlap, off_by_one or different."""
    spans = ((start, end), (other, other_end))
    keys = F.struct(*[folio_key(x).alias(f"k{i}{j}") for i, (lo, hi) in enumerate(spans) for j, x in enumerate((lo, F.coalesce(hi, lo)))], *[F.coalesce(x, F.lit("")).alias(f"t{i}{j}") for i, (lo, hi) in enumerate(spans) for j, x in enumerate((lo, F.coalesce(hi, lo)))])

    def told(x: Column) -> Column:
        lo, hi, low, high = F.least(x["k00"], x["k01"]), F.greatest(x["k00"], x["k01"]), F.least(x["k10"], x["k11"]), F.greatest(x["k10"], x["k11"])
        apart = F.greatest(low["col1"] - hi["col1"], lo["col1"] - high["col1"])
        first, last = x["t00"] == x["t10"], x["t01"] == x["t11"]
        return (
            F.when((x["t00"] == "") | (x["t10"] == ""), "missing")
            .when(x["k00"]["col1"].isNull() | x["k10"]["col1"].isNull(), F.when(first & last, "exact").when(first | last, "overlap").otherwise("different"))
            .when((lo == low) & (hi == high), "exact")
            .when(((lo <= low) & (high <= hi)) | ((low <= lo) & (hi <= high)), "within")
            .when((lo <= high) & (low <= hi), "overlap")
            .when(apart == 1, "off_by_one")
            .otherwise("different")
        )

    return F.get(F.transform(F.array(keys), told), F.lit(0))  # the keys are made once, then compared


def modern_date(c: Column) -> Column:
    """The modern ISO date of the first Italian date in c: a second year decides; without one, a date before 25 March
    could be of two years until 1750, and is null."""
    iso, short = italian_date(c), F.regexp_extract(c, DAY, 4)
    rest = F.substring(iso, 5, 6)
    return F.when(short != "", F.concat(F.substring(iso, 1, 2), short, rest)).when((F.substring(iso, 6, 5) >= "03-25") | (iso >= "1750"), iso)


def shown_date(iso: Column) -> Column:
    """An ISO date as 20 Mar 1534."""
    return F.date_format(F.to_date(iso), "d MMM yyyy")


def display_text(c: Column) -> Column:
    """Text for people: a dash where there is none."""
    bare = F.trim(F.coalesce(c.cast("string"), F.lit("")))
    return F.when(bare == "", "—").otherwise(bare)


def yes_no(c: Column) -> Column:
    return F.when(c.cast("int") == 1, "Yes").when(c.cast("int") == 0, "No").otherwise("—")


def clean_document(c: Column, breaks: str = "\n") -> Column:
    """Line ends that were stored as the letters \\r\\n, as breaks."""
    return F.regexp_replace(F.coalesce(c, F.lit("")), r"(\\r)?\\n|\\r", breaks)


def display_name(first: Column, father: Column, last: Column) -> Column:
    """First name, father's name and family name, without what is missing."""
    full = F.array_join(F.filter(F.array(first, father, last), lambda x: F.trim(F.coalesce(x, F.lit(""))) != ""), " ")
    return F.when(full == "", "(unnamed)").otherwise(full)


def strength_band(c: Column) -> Column:
    return F.when(c.isNull(), "unknown").when(c >= 0.75, "strong").when(c >= 0.5, "partial").otherwise("weak")
