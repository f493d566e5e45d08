"""Identifier functions (K1-K11). All are column expressions but the two edit distances, which are Arrow functions over batches of pairs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that readers confuse on stamped metal.
LETTER_TO_DIGIT = {"O": "0", "Q": "0", "D": "0", "I": "1", "L": "1", "T": "7", "Z": "2", "E": "3", "A": "4", "S": "5", "G": "6", "B": "8"}
DIGIT_TO_LETTER = {"0": "O", "1": "I", "2": "Z", "3": "E", "4": "A", "5": "S", "6": "G", "7": "T", "8": "B"}
CONFUSABLE = ("O0", "Q0", "D0", "I1", "L1", "T7", "Z2", "E3", "A4", "S5", "G6", "B8", "UV", "MN", "CG", "56", "80", "K1")
MIN_RELIABLE, MIN_MASK_SAMPLES, MIN_FRAGMENT = 7, 8, 6
# Label words in front of an identifier, and other marks that are stamped beside it.
LABEL = r"^(?:\s*(?:N[°º]?|NO|NRO|NUM(?:ERO)?|DE|DEL|SERIE|SERIAL|SER|S\s*/\s*N|SN)\b[\s.:\-]*)+"
MARKING = (
    r"P[WHT]\s*[0-9]|\b(?:TP|TW|WP)\s*[0-9]|BAR\b|\bKG\b|\b(?:O?NU|UN)\s*[0-9]{4}\b"
    r"|\b(?:19|20)[0-9]{2}\s*[/.\-]\s*[0-9]{1,2}\b|\b[0-9]{1,2}\s*[/.\-]\s*(?:19|20)?[0-9]{2}\b"
)
FRAGMENT_BREAK = r"[\s|/\\]+"


def serial_charset(c: Column) -> Column:
    """K1: upper case, right of the last colon, label words off the front, letters and digits only; null gives an empty text."""
    t = F.substring_index(F.upper(F.trim(F.coalesce(c, F.lit("")))), ":", -1)
    return F.regexp_replace(F.regexp_replace(t, LABEL, ""), "[^A-Z0-9]", "")


def is_marking(c: Column) -> Column:
    """K2: pressures, weights, UN numbers and dates are stamped too, but no identifiers."""
    return F.coalesce(F.upper(c).rlike(MARKING), F.lit(False))


def allowed_errors(c: Column) -> Column:
    """K3."""
    n = F.length(c)
    return F.when(n < 6, 0).otherwise(F.floor(n / 4)).cast("int")


def mask_regex(mask: Column) -> Column:
    """The pattern of a positional mask: D digit, A letter, ? anything."""
    return F.concat(F.lit("^"), F.replace(F.replace(F.replace(mask, F.lit("D"), F.lit("[0-9]")), F.lit("A"), F.lit("[A-Za-z]")), F.lit("?"), F.lit(".")), F.lit("$"))


def matches_pattern(c: Column, mask: Column, min_length: Column, max_length: Column) -> Column:
    """K4: length within bounds and, if there is a mask, the type of every position."""
    return F.length(c).between(min_length, max_length) & F.when(mask.isNull(), F.lit(True)).otherwise(F.regexp(c, mask_regex(mask)))


def corrected(c: Column, mask: Column) -> Column:
    """K6: struct of the text and of notes. Only where the mask wants the other type is a character replaced."""
    to_digit = F.create_map(*[F.lit(x) for kv in LETTER_TO_DIGIT.items() for x in kv])
    to_letter = F.create_map(*[F.lit(x) for kv in DIGIT_TO_LETTER.items() for x in kv])
    swap = lambda ch, kind: F.when(kind == "D", to_digit[ch]).when(kind == "A", to_letter[ch])
    chars, kinds = F.split(c, ""), F.split(mask, "")
    fits = mask.isNotNull() & (F.length(c) == F.length(mask))
    pairs = F.zip_with(chars, kinds, lambda ch, kind: F.struct(ch.alias("ch"), swap(ch, kind).alias("to")))
    text = F.array_join(F.transform(pairs, lambda p: F.coalesce(p["to"], p["ch"])), "")
    notes = F.array_compact(
        F.transform(
            pairs,
            lambda p, i: F.when(
                p["to"].isNotNull(), F.concat_ws("", F.lit("pos "), i.cast("string"), F.lit(": "), p["ch"], F.lit(" -> "), p["to"])
            )
        )
    )
    return F.struct(F.when(fits, text).otherwise(c).alias("text"), F.when(fits, notes).otherwise(F.array().cast("array<string>")).alias("notes"))


def canonical(c: Column) -> Column:
    """K9: every character as its confusion class."""
    return F.translate(c, "".join(LETTER_TO_DIGIT) + "K", "".join(LETTER_TO_DIGIT.values()) + "1")


def bigrams(c: Column) -> Column:
    """K9: the distinct pairs of neighbours of the canonical text."""
    t = canonical(c)
    return F.when(F.length(t) < 2, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.substring(t, i, F.lit(2))))
    )


def shape(c: Column) -> Column:
    """Digits as D, letters as A."""
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
    return F.translate(c, letters + "0123456789", "A" * len(letters) + "D" * 10)


def _classes() -> dict[str, str]:
    """Every character of an identifier to the first one that it can be confused with, over any number of steps."""
    of = {c: c for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
    for a, b in CONFUSABLE:
        low, high = sorted((of[a], of[b]))
        of = {c: low if x == high else x for c, x in of.items()}
    return of


COARSE = _classes()
COARSE_CLASSES = sorted(set(COARSE.values()))


def coarse(c: Column) -> Column:
    """Every character as its class of confusable ones: what costs half an edit costs nothing here."""
    moved = [x for x, low in COARSE.items() if x != low]
    return F.translate(c, "".join(moved), "".join(COARSE[x] for x in moved))


def _costs() -> np.ndarray:
    """Costs of a substitution, in halves of an edit."""
    cost = np.full((256, 256), 2, np.int16)
    for a, b in CONFUSABLE:
        cost[ord(a), ord(b)] = cost[ord(b), ord(a)] = 1
    np.fill_diagonal(cost, 0)
    return cost


COSTS = _costs()
FLAT_COSTS = COSTS.astype(np.uint8).ravel()


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all texts one after the other (those beyond Latin-1 as 255), and where each text begins."""
    plain = texts.fill_null("").cast(pa.large_string())
    ends = np.frombuffer(plain.buffers()[1], np.int64)[plain.offset : plain.offset + len(plain) + 1]
    data = np.frombuffer(plain.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    if not len(data) or data.max() < 128:
        return data, ends - ends[0]
    words = plain.to_pylist()
    wide = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    return np.minimum(wide, 255).astype(np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in words])])


def _padded(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, filler: int) -> np.ndarray:
    """Texts as columns, the shorter ones filled up at their ends."""
    at = np.arange(int(sizes.max(initial=0)))[:, None]
    if not len(codes):
        return np.full((len(at), len(sizes)), filler, np.uint8)
    found = np.take(codes, starts + at, mode="clip")
    found[at >= sizes] = filler
    return found


def _align(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, anywhere: bool, cost, edit: int) -> np.ndarray:
    """Distances of the texts in the columns of ``a`` and ``b`` (of sizes ``na`` and ``nb``), all columns at once.

    ``cost(i)`` gives the substitution of row i of ``a`` by every row of ``b``. Characters behind the end of a text equal nothing, and so never make a distance smaller.
    """
    kind = np.uint8 if edit * max(len(a), len(b)) < 250 else np.int32
    row = np.zeros((len(b) + 1, len(na)), kind)
    if not anywhere:
        row += (edit * np.arange(len(b) + 1, dtype=kind))[:, None]
    everyone = np.arange(len(na))
    ended = lambda at: row[:, at].min(0) if anywhere else row[nb[at], everyone[at]]
    out = ended(everyone).astype(np.int64)
    for i in range(len(a)):
        step = np.minimum(row[:-1] + cost(i).astype(kind, copy=False), row[1:] + kind(edit))
        row[0] = edit * (i + 1)
        for j in range(len(b)):
            np.minimum(step[j], row[j] + kind(edit), out=row[j + 1])
        last = np.flatnonzero(na == i + 1)
        if len(last):
            out[last] = ended(last)
    return out


AT_ONCE = 4096


def pair_distances(left: pa.Array | list[str], right: pa.Array | list[str], anywhere: bool) -> np.ndarray:
    """Weighted edit distance of pairs; with ``anywhere`` of the left text to the best part of the right one. Pairs of similar lengths go together."""
    left, right = (x if isinstance(x, pa.Array) else pa.array(x, pa.string()) for x in (left, right))
    (ca, sa), (cb, sb) = _codes(left), _codes(right)
    na, nb = np.diff(sa), np.diff(sb)
    out = np.zeros(len(left), np.float64)
    order = np.lexsort((nb, na))
    for k in range(0, len(order), AT_ONCE):
        at = order[k : k + AT_ONCE]
        a, b = _padded(ca, sa[at], na[at], 254), _padded(cb, sb[at], nb[at], 253)
        column = b.astype(np.intp)
        out[at] = _align(a, b, na[at], nb[at], anywhere, lambda i: np.take(FLAT_COSTS, column + 256 * a[i].astype(np.intp)), 2) / 2  # noqa: B023
    return out


COARSE_CODES = np.arange(256, dtype=np.uint8)
for _c, _low in COARSE.items():
    COARSE_CODES[ord(_c)] = ord(_low)


def close_distances(left: pa.Array, right: pa.Array, limits: np.ndarray, anywhere: bool) -> np.ndarray:
    """The same distances where they are within the limits, NaN elsewhere.

    The plain edit distance of the coarse texts, which is never larger, is found first; only what it lets through is measured with weights.
    """
    (ca, sa), (cb, sb) = _codes(left), _codes(right)
    na, nb = np.diff(sa), np.diff(sb)
    a, b = _padded(COARSE_CODES[ca], sa[:-1], na, 254), _padded(COARSE_CODES[cb], sb[:-1], nb, 253)
    out = np.full(len(na), np.nan)
    near = np.flatnonzero(_align(a, b, na, nb, anywhere, lambda i: a[i] != b, 1) <= limits)
    if len(near):
        pick = pa.array(near)
        found = pair_distances(left.take(pick), right.take(pick), anywhere)
        out[near] = np.where(found <= limits[near], found, np.nan)
    return out


def _close(anywhere: bool):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def distance(left: pa.Array, right: pa.Array, limit: pa.Array) -> pa.Array:
        return pa.array(close_distances(left, right, limit.to_numpy(zero_copy_only=False), anywhere), pa.float64(), from_pandas=True)

    return distance


def distance_within(left: Column, right: Column, limit: Column, anywhere: bool) -> Column:
    """K8 or, ``anywhere``, K10 (of the left text to the best part of the right one), null beyond the limit. Neither side may be null."""
    return _close(anywhere)(left, right, limit.cast("double"))


def _distance(anywhere: bool):
    from pyspark.sql.functions import arrow_udf

    @arrow_udf("double")
    def distance(left: pa.Array, right: pa.Array) -> pa.Array:
        unknown = (left.is_null().to_numpy(zero_copy_only=False)) | (right.is_null().to_numpy(zero_copy_only=False))
        return pa.array(pair_distances(left, right, anywhere), pa.float64(), mask=unknown)

    return distance


def weighted_edit_distance(left: Column, right: Column) -> Column:
    """K8: Levenshtein distance in which confusable characters cost 0.5. Null if a side is null."""
    return _distance(False)(left, right)


def substring_distance(serial: Column, text: Column) -> Column:
    """The same of the serial to the best part of the text, without the bigram filter, which joins apply beforehand."""
    return _distance(True)(serial, text)


def bigrams_needed(serial: Column, limit: Column) -> Column:
    """How many bigrams a text must share at least to be within ``limit``."""
    return F.length(serial) - 1 - 2 * limit


def register(spark) -> None:
    """Both distances as SQL functions, and K7's fragments as a table function for lateral joins: ``serial_fragments(text)`` gives (frag_ord, fragment, serial) of the whole
    text and of its tokens, as far as they have a digit and are no markings. Its body is SQL, so it runs like any other expression."""
    spark.udf.register("weighted_edit_distance", _distance(False))
    spark.udf.register("fuzzy_substring_distance", _distance(True))
    raw = lambda pattern: "r'" + pattern.replace("'", r"\x27") + "'"
    serial = f"regexp_replace(regexp_replace(substring_index(upper(trim(coalesce(fragment, ''))), ':', -1), {raw(LABEL)}, ''), '[^A-Z0-9]', '')"
    spark.sql(f"""
        CREATE OR REPLACE TEMPORARY FUNCTION serial_fragments(t STRING) RETURNS TABLE (frag_ord INT, fragment STRING, serial STRING)
        RETURN SELECT frag_ord, fragment, serial FROM (SELECT frag_ord, fragment, {serial} AS serial FROM (SELECT posexplode(concat(array(t), split(t, {raw(FRAGMENT_BREAK)}))) AS (frag_ord, fragment)))
        WHERE NOT coalesce(upper(fragment) RLIKE {raw(MARKING)}, false) AND serial RLIKE '[0-9]'
    """)
