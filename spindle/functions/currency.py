"""Signatures of currency names: coin, exchange figures, places and qualities, free of spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import fold_accents

#: Spellings of coins, by coin.
COINS = {
    "scudo": "scudi scudo", "ducato": "ducati ducato", "fiorino": "fiorini fiorino", "lira": "lire lira", "pezza": "pezze pezza", "onza": "onze onza oncie once",
    "piastra": "piastre piastra", "carlino": "carlini carlino", "reale": "reali reale", "zecchino": "zecchini", "ruspo": "ruspi", "franco": "franchi",
    "cruzado": "cruzados crusadi cruciati cruzado", "sterlina": "sterline sterlina starlini sterlini",
}
#: Spellings of the units that a figure counts, by unit.
UNITS = {
    "lira": "lire lira", "soldo": "soldi soldo", "denaro": "denari denaro", "carlino": "carlini carlino", "taro": "tari taro", "giulo": "giuli giulio",
    "paolo": "pauli paoli paolo apuli", "bolognino": "bolognini", "grosso": "grossi grosso", "maravedi": "maravedis maravilis maravidis maravedi", "reis": "reis",
    "reale": "reali reale", "marco": "marchi marco", "tornese": "tornesi", "para": "para", "sterlina": "sterline sterlini", "fiorino": "fiorini",
}
#: Spellings of places' adjectives.
PLACES = {
    "fiorentina": "fiorentina fiorentine fiorentini", "romana": "romana romano", "anconetana": "anconetana", "veneziana": "veneziani veneziana",
    "piemontese": "piemontesi", "spagnola": "spagnuola spagnola",
}
#: Spellings of qualities.
QUALITIES = {
    "oro": "oro", "largo": "larghi largo larghe", "suggello": "suggello suggelo", "sol": "sole soli", "corrente": "correnti corrente", "camera": "camera",
    "stampa": "stampa stampe", "vecchio": "vecchia vecchio", "antico": "antico antica", "banco": "banco", "argento": "argento", "platta": "platta",
    "moneta": "moneta", "nuova": "nuova", "nuovo": "nuovo", "lunga": "lunga", "lungo": "lungo",
}
#: Words that say nothing.
STOP = "di d de del della dello dei delle degli a e et per l lo la il in ragione ciascuno ciascun luno luna uno una da con valuta".split()
#: Fractions as written.
FRACTIONS = {"½": "1/2", "¼": "1/4", "¾": "3/4", "⅓": "1/3", "⅔": "2/3"}


def _by_spelling(table: dict[str, str]) -> dict[str, str]:
    return {word: name for name, words in table.items() for word in words.split()}


def _lookup(table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])


_UNIT = "(?:" + "|".join(_by_spelling(UNITS)) + ")"
_FIGURE = r"\d+(?:/\d+)?"
#: A figure with the unit before it, else with the one after it, else alone: read from the left, each unit goes to one figure.
RATE = rf"(?<= )(?:{_UNIT} {_FIGURE}|{_FIGURE} {_UNIT}|{_FIGURE})(?= )"


def currency_words(c: Column) -> Column:
    """Lower-case words of a name: no accents, elisions cut, fractions and lire:soldi spelt out."""
    out = F.lower(c)
    for sign, spelt in FRACTIONS.items():
        out = F.replace(out, F.lit(sign), F.lit(spelt))
    out = F.regexp_replace(F.translate(fold_accents(out), "’`´", "'''"), r"\bd'|'", " ")
    out = F.regexp_replace(out, r"\blire?\s*(\d+)\s*[:.]\s*(\d+)", " lira $1 soldo $2 ")
    return F.trim(F.regexp_replace(F.regexp_replace(out, "[^a-z0-9/ ]", " "), " +", " "))


def currency_parts(c: Column) -> Column:
    """(coin, rates, places, qualities) of a name, the latter three as sorted arrays; null for a name without words.

    A rate is unit=figure, with ? where no unit stands beside the figure. Units without a figure and coins that others
    are counted in are among the places, marked as such, since they tell currencies apart.
    """
    words = currency_words(c)
    first = F.substring_index(words, " ", 1)
    rest = F.concat(F.lit(" "), F.trim(F.substring(words, F.length(first) + 1, F.length(words))), F.lit(" "))
    rates = F.transform(F.regexp_extract_all(rest, F.lit(f"({RATE})"), F.lit(1)), lambda r: F.concat_ws("=", F.coalesce(_lookup(_by_spelling(UNITS))[F.regexp_extract(r, "[a-z]+", 0)], F.lit("?")), F.regexp_extract(r, _FIGURE, 0)))
    left = F.filter(F.split(F.regexp_replace(rest, RATE, ""), " +"), lambda w: w != "")
    qualities = _by_spelling(QUALITIES)
    known = {w: f"per:{n}" for w, n in _by_spelling(COINS).items()} | {w: f"§{n}" for w, n in _by_spelling(UNITS).items()} | _by_spelling(PLACES)
    places = F.filter(left, lambda w: ~w.isin(*qualities, *STOP))
    return F.when(
        words != "",
        F.struct(
            F.coalesce(_lookup(_by_spelling(COINS))[first], first).alias("coin"),
            F.array_sort(rates).alias("rates"),
            F.array_sort(F.array_distinct(F.transform(places, lambda w: F.coalesce(_lookup(known)[w], w)))).alias("places"),
            F.array_sort(F.array_distinct(F.array_compact(F.transform(left, lambda w: _lookup(qualities)[w])))).alias("qualities"),
        ),
    )


def _shown(p: Column, rates: Column) -> Column:
    parts = [p["coin"], *(F.nullif(F.array_join(a, " "), F.lit("")) for a in (rates, p["places"], p["qualities"]))]
    return F.when(p.isNotNull(), F.concat_ws(" · ", *parts))


def currency_signature(c: Column) -> Column:
    """What names of one currency have in common, as text; null for a name without words."""
    p = currency_parts(c)
    return _shown(p, p["rates"])


def currency_skeleton(c: Column) -> Column:
    """The signature without the figures: alike but for the rate."""
    p = currency_parts(c)
    return _shown(p, F.array_sort(F.transform(p["rates"], lambda r: F.substring_index(r, "=", 1))))
