"""Text normalisation as column expressions (N1-N16): column in, column out, null for what can't be read.

Everything stays inside generated JVM code except the few higher-order functions over alias lists, which are constants.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Markers of absent data, codes and their spellings, as the labels and cards in the field use them.
ABSENT = ("SN", "S/N", "S N", "NA", "N/A", "NO", "NINGUNO", "SIN DATO", "-", "--", "")
GASES = {
    "CO2": ("CO2", "DIOXIDO DE CARBONO", "ANHIDRIDO CARBONICO", "C02", "CARBONICO"),
    "O2": ("O2", "OXIGENO", "OXIGENO MEDICINAL", "02"),
    "AR": ("AR", "ARGON"),
    "N2": ("N2", "NITROGENO"),
    "ACET": ("ACETILENO", "C2H2", "ACET"),
    "H2": ("H2", "HIDROGENO"),
    "HE": ("HE", "HELIO"),
    "AIR": ("AIRE", "AIRE COMPRIMIDO", "AIR"),
    "MIX": ("MEZCLA", "MIX", "ARGAMIX", "ARGOMIX"),
}
COLOURS = {
    "gris": ("GRIS", "PLOMO", "GREY", "GRAY"),
    "negro": ("NEGRO", "BLACK"),
    "verde": ("VERDE", "GREEN"),
    "azul": ("AZUL", "BLUE"),
    "blanco": ("BLANCO", "WHITE"),
    "rojo": ("ROJO", "RED"),
    "amarillo": ("AMARILLO", "YELLOW"),
    "naranja": ("NARANJA", "ANARANJADO", "ORANGE"),
    "marron": ("MARRON", "MAARON", "MARON", "CAFE", "BROWN"),
}
COUNTRIES = {
    "CHN": ("CHN", "CN", "CHINA"),
    "USA": ("USA", "US", "EEUU", "EE UU", "ESTADOS UNIDOS", "UNITED STATES"),
    "BRA": ("BRA", "BR", "BRASIL", "BRAZIL"),
    "ARG": ("ARG", "AR", "ARGENTINA"),
    "PER": ("PER", "PE", "PERU"),
    "ESP": ("ESP", "ES", "ESPANA"),
    "ITA": ("ITA", "IT", "ITALIA", "ITALY"),
    "DEU": ("DEU", "DE", "ALEMANIA", "GERMANY"),
    "IND": ("IND", "INDIA"),
    "JPN": ("JPN", "JP", "JAPON", "JAPAN"),
    "KOR": ("KOR", "KR", "COREA", "KOREA"),
    "MEX": ("MEX", "MX", "MEXICO"),
    "CHL": ("CHL", "CL", "CHILE"),
    "COL": ("COL", "CO", "COLOMBIA"),
}
# Patterns that must accept exactly what labels in the field say; digits are ASCII, for both engines that run them.
MIXTURE = r"[0-9]{1,3}\s*%|MEZCLA|MIX"
COLOUR_BREAK = r"\s*(?:/|-|\bY\b|\bCON\b)\s*"
PERIOD = r"CADA\s*([0-9]{1,2})\s*(?:ANOS?|ANIOS?|YEARS?)"
# Limits and factors of the measures.
KG_PER_LB = 0.45359237
DIAMETER_CM, HEIGHT_CM = (10.0, 60.0), (30.0, 200.0)
MOST_LITRES, MOST_CUBIC = 500, 100
YEAR_PIVOT = 70


def _decompositions() -> tuple[str, str, dict[str, str]]:
    """Of every code point but Hangul syllables, the compatibility form without combining marks: characters that become one letter and these letters, then
    those that vanish, as both arguments of translate(); and those that become several."""
    single, gone, several = [], [], {}
    for code in range(0x80, 0x110000):
        if 0xD800 <= code < 0xE000 or 0xAC00 <= code < 0xD7A4:
            continue
        ch = chr(code)
        base = "".join(c for c in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(c))
        if base == ch:
            continue
        if len(base) == 1:
            single.append((ch, base))
        elif base:
            several[ch] = base
        else:
            gone.append(ch)
    return "".join(c for c, _ in single) + "".join(gone), "".join(b for _, b in single), several


ACCENTED, PLAIN, SEVERAL = _decompositions()


HANGUL = range(0xAC00, 0xD7A4)
LONGER = "".join(SEVERAL) + "".join(map(chr, HANGUL))
LEADS, VOWELS, TAILS = ("".join(map(chr, r)) for r in (range(0x1100, 0x1113), range(0x1161, 0x1176), range(0x11A8, 0x11C3)))


def _longer(ch: Column) -> Column:
    """One character that becomes several: a syllable by its number, others by table."""
    number = F.ascii(ch) - HANGUL.start
    part = lambda letters, at: F.substring(F.lit(letters), at.cast("int"), F.lit(1))
    tail = F.when(number % 28 > 0, part(TAILS, number % 28)).otherwise(F.lit(""))
    syllable = F.concat(part(LEADS, F.floor(number / 588) + 1), part(VOWELS, F.floor(number % 588 / 28) + 1), tail)
    table = F.element_at(F.map_from_arrays(F.split(F.lit("\n".join(SEVERAL)), "\n"), F.split(F.lit("\n".join(SEVERAL.values())), "\n")), ch)
    return F.when(number.between(0, len(HANGUL) - 1), syllable).otherwise(F.coalesce(table, ch))


def strip_accents(c: Column) -> Column:
    """Compatibility decomposition without combining marks, for every code point. Texts with a character that becomes several go through their characters; others are translated at once."""
    plain = F.translate(c, ACCENTED, PLAIN)
    return F.when(c.rlike(r"[^\x00-\x7F]") & (F.translate(c, LONGER, "") != c), F.array_join(F.transform(F.split(plain, ""), _longer), "")).otherwise(plain)


def once(c: Column, f) -> Column:
    """``f`` of a column that is computed once however often ``f`` names it: branches that may not be taken would each compute it anew."""
    return F.transform(F.array(c), f)[0]


def clean_text(c: Column) -> Column:
    """No accents, single spaces, upper case."""
    return F.upper(F.trim(F.regexp_replace(strip_accents(c), r"\s+", " ")))


def is_absent(c: Column, clean: bool = False) -> Column:
    """Null counts as absent. Here and below ``clean`` says that the text is cleaned already."""
    return F.coalesce(c if clean else clean_text(c), F.lit("")).isin(*ABSENT)


def first_code(text: Column, table: dict[str, tuple[str, ...]]) -> Column:
    """The first code one of whose spellings is the whole text."""
    return F.coalesce(*[F.when(text.isin(*names), F.lit(code)) for code, names in table.items()])


def gas(c: Column, clean: bool = False) -> Column:
    """A mixture if it says so or names several gases; whole spellings before contained ones of 3 letters and more."""
    t = c if clean else clean_text(c)
    named = F.array_compact(F.array(*[F.when(F.greatest(*[t.contains(n) for n in names if len(n) >= 3], F.lit(False)), F.lit(code)) for code, names in GASES.items()]))
    inside = once(named, lambda x: F.when(F.size(x) > 1, F.lit("MIX")).when(F.size(x) == 1, F.get(x, F.lit(0))))
    return F.when(~is_absent(t, True), F.when(t.rlike(MIXTURE), F.lit("MIX")).otherwise(F.coalesce(first_code(t, GASES), inside)))


def colour(c: Column, clean: bool = False) -> Column:
    """For each part of a compound the first colour it names that isn't taken yet, joined by a slash."""
    fits = lambda chunk, names: F.greatest(*[chunk.contains(n) for n in names], F.lit(False))

    def step(taken: Column, chunk: Column) -> Column:
        free = [F.when(fits(chunk, names) & ~F.array_contains(taken, code), F.array(F.lit(code))) for code, names in COLOURS.items()]
        return F.concat(taken, F.coalesce(*free, F.array().cast("array<string>")))

    t = c if clean else clean_text(c)
    found = F.aggregate(F.split(t, COLOUR_BREAK), F.array().cast("array<string>"), step)
    return F.when(~is_absent(t, True) & (F.size(found) > 0), F.array_join(found, "/"))


def _part(text: Column, pattern: str, group: int) -> Column:
    """A group of the first match; null without a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


#: Dates by their parts: a month, a year of four digits, what may stand between.
MONTH, YEAR, GAP = "(?:0?[1-9]|1[0-2])", "(?:19|20)[0-9]{2}", r"\s*[/.\-]\s*"


def month_year(c: Column, clean: bool = False) -> Column:
    """Yyyy-MM from MM/YYYY, else YYYY/MM, else MM/YY."""
    t = F.coalesce(c if clean else clean_text(c), F.lit(""))
    digits = lambda pattern: F.nullif(F.regexp_replace(F.regexp_extract(t, rf"\b{pattern}\b", 0), "[^0-9]", ""), F.lit(""))
    dated = lambda y, m: F.concat(y, F.lit("-"), F.lpad(m, 2, "0"))
    after, before, short = digits(MONTH + GAP + YEAR), digits(YEAR + GAP + MONTH), digits(MONTH + GAP + "[0-9]{2}")
    head = lambda x, k: F.substring(x, F.lit(1), F.length(x) - k)
    century = lambda x: F.when(F.right(x, F.lit(2)) >= str(YEAR_PIVOT), "19").otherwise("20")
    return F.coalesce(
        once(after, lambda x: dated(F.right(x, F.lit(4)), head(x, 4))),
        once(before, lambda x: dated(F.left(x, F.lit(4)), F.substring(x, F.lit(5), F.lit(2)))),
        once(short, lambda x: dated(F.concat(century(x), F.right(x, F.lit(2))), head(x, 2))),
    )


def year(c: Column, clean: bool = False) -> Column:
    """N7."""
    return F.coalesce(F.substring(month_year(c, clean), 1, 4).cast("int"), _part(F.coalesce(c if clean else clean_text(c), F.lit("")), r"\b((?:19|20)[0-9]{2})\b", 1).cast("int"))


def number(c: Column) -> Column:
    """The first number, comma or point, spaces inside ignored."""
    return F.replace(_part(F.regexp_replace(F.coalesce(c, F.lit("")), " ", ""), r"([0-9]+(?:[.,][0-9]+)?)", 1), F.lit(","), F.lit(".")).try_cast("double")


def pounds(t: Column) -> Column:
    """Whether a clean text speaks of pounds."""
    return t.contains("LB") | t.contains("POUND")


def kilograms(n: Column, in_pounds: Column) -> Column:
    """N9, of a number."""
    kg = F.when(in_pounds, n * KG_PER_LB).otherwise(n)
    return F.when((kg > 0) & (kg < 500), F.round(kg, 2))


def weight_kg(c: Column, clean: bool = False) -> Column:
    """N9."""
    t = c if clean else clean_text(c)
    return kilograms(number(t), pounds(t))


def up_to(n: Column, most: float, digits: int) -> Column:
    """N10, of a number."""
    return F.when((n > 0) & (n <= most), F.round(n, digits))


def litres(c: Column, clean: bool = False) -> Column:
    """N10, litres."""
    return up_to(number(c if clean else clean_text(c)), MOST_LITRES, 2)


def cubic_metres(c: Column, clean: bool = False) -> Column:
    """N10, cubic metres."""
    return up_to(number(c if clean else clean_text(c)), MOST_CUBIC, 3)


def centimetres(n: Column, expected: tuple[float, float]) -> Column:
    """N11, of a number: struct of value and warning. Outside the expected range it is read as metres, millimetres or inches, the first that fits."""
    low, high = expected
    made = lambda v, warning: F.struct(F.round(v, 2).alias("value"), warning.cast("string").alias("warning"))
    nothing = F.lit(None).cast("double")
    tried = F.when(n.isNull(), made(nothing, F.lit(None))).when(n.between(low, high), made(n, F.lit(None)))
    for v, unit in ((n * 100.0, "m"), (n / 10.0, "mm"), (n * 2.54, "in")):
        tried = tried.when(v.between(low, high), made(v, F.lit(f"read as {unit}")))
    return tried.otherwise(made(nothing, F.lit("out of range")))


def length_cm(c: Column, expected: tuple[float, float], clean: bool = False) -> Column:
    """N11."""
    return centimetres(number(c if clean else clean_text(c)), expected)


def country(c: Column, strict: bool = False, clean: bool = False) -> Column:
    """Whole spelling, else whole word; declared order of codes decides. strict leaves out two-letter spellings."""
    table = {k: tuple(n for n in names if len(n) > 2 or not strict) for k, names in COUNTRIES.items()}
    t = c if clean else clean_text(c)
    words = F.regexp_extract_all(t, F.lit("([A-Z]+)"), 1)
    inside = once(words, lambda x: F.coalesce(*[F.when(F.arrays_overlap(x, F.array(*map(F.lit, names))), F.lit(code)) for code, names in table.items()]))
    return F.when(~is_absent(t, True), F.coalesce(first_code(t, table), inside))


def hydrostatic(c: Column, clean: bool = False) -> Column:
    """Struct of date and period in years, either of them null."""
    t = F.coalesce(c if clean else clean_text(c), F.lit(""))
    return F.struct(F.when(~is_absent(t, True), month_year(t, True)).alias("date"), F.when(~is_absent(t, True), _part(t, PERIOD, 1).cast("int")).alias("period"))


def measure_unit(c: Column, clean: bool = False) -> Column:
    """Cubic metres before kilograms."""
    t = c if clean else clean_text(c)
    return F.when(~is_absent(t, True), F.when(t.rlike(r"\bM3\b|\bM\^?3\b|METRO.?S? CUBICO"), F.lit("M3")).when(t.rlike(r"\bKG\b|KILO"), F.lit("KG")))


# Canonical names of the capture conditions, in the order of their digits.
CONDITIONS = ("1.Frontal", "2.Diagonal", "3.Cerca", "4.Lejos", "5.Luz normal", "6.Poca luz")
DESCRIPTION = "Descripción"


def folded(c: Column) -> Column:
    """Lower case, without accents, letters and digits only."""
    return F.regexp_replace(F.lower(strip_accents(c)), "[^a-z0-9]", "")


def condition_name(c: Column) -> Column:
    """N15, condition folder: a canonical name, the description folder, else the leading digit; null for unknown names."""
    t = folded(c)
    whole = [F.when(t == "".join(x for x in name.lower() if x.isalnum()), F.lit(name)) for name in CONDITIONS]
    digit = [F.when(t.startswith(str(k)), F.lit(name)) for k, name in enumerate(CONDITIONS, 1)]
    return F.coalesce(*whole, F.when(t.startswith("descripcion"), F.lit(DESCRIPTION)), *digit)


def asset_name(c: Column) -> Column:
    """N15, asset folder: Cilindro_ and the number on three digits at least; null for unknown names."""
    n = F.nullif(F.regexp_extract(F.lower(c), r"cilindro[_\s-]*([0-9]+)", 1), F.lit("")).cast("long").cast("string")
    return F.concat(F.lit("Cilindro_"), F.lpad(n, F.greatest(F.length(n), F.lit(3)), F.lit("0")))


def flat_name(path: Column) -> Column:
    """N16."""
    return F.regexp_replace(path, "/", "__")
