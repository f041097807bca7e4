"""Term vectors of one text as column expressions: counts and TF-IDF weights inside the row."""

from pyspark.sql import Column, functions as F

from tidewatch.functions.text import bind, constant, lookup, terms


def places(vocabulary):
    """Function from a term to its 1-based number, NULL for others."""
    return lookup({term: number for number, term in enumerate(vocabulary, start=1)}, "int")


def sorted_terms(text: Column, stop_words) -> Column:
    """(term, first) of every occurrence; one of each term is its first."""
    return bind(F.sort_array(terms(text, stop_words)), lambda found: F.transform(
        found, lambda term, i: F.struct(term.alias("term"), F.when(i == 0, True).otherwise(
            F.element_at(found, F.greatest(i, F.lit(1))) != term).alias("first"))))


def term_counts(text: Column, place, stop_words) -> Column:
    """(place, n) of every term of a text that ``place`` knows, in the order of the places."""
    found = F.filter(F.transform(terms(text, stop_words), place), lambda number: number.isNotNull())

    def runs(numbers):
        first = F.filter(F.sequence(F.lit(1), F.size(numbers)),
                         lambda i: (i == 1) | (F.element_at(numbers, F.greatest(i - 1, F.lit(1))) != F.element_at(numbers, i)))
        return bind(first, lambda starts: F.zip_with(
            starts, F.slice(F.array_append(starts, F.size(numbers) + 1), 2, F.size(starts)),
            lambda start, end: F.struct(F.element_at(numbers, start).alias("place"), (end - start).alias("n"))))

    none = F.array().cast("array<struct<place:int,n:int>>")
    return bind(F.sort_array(found), lambda numbers: F.when(F.size(numbers) > 0, runs(numbers)).otherwise(none))


def damped(count: Column, sublinear: bool) -> Column:
    count = count.cast("double")
    return 1 + F.ln(count) if sublinear else count


def tfidf_vector(counts: Column, idf: Column, sublinear: bool = False) -> Column:
    """(place, n, weight) of the counted terms, weights of length one together."""
    raw = F.transform(counts, lambda c: F.struct(
        c["place"].alias("place"), c["n"].alias("n"), (damped(c["n"], sublinear) * F.element_at(idf, c["place"])).alias("weight")))
    return bind(raw, lambda cells: bind(
        F.sqrt(F.aggregate(cells, F.lit(0.0), lambda held, c: held + c["weight"] * c["weight"])),
        lambda size: F.transform(cells, lambda c: F.struct(
            c["place"].alias("place"), c["n"].alias("n"), (c["weight"] / size).alias("weight")))))
