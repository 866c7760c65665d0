"""Which text an element holds, as column expressions.

One fold over the pieces of a page keeps the elements that are open. Where an element ends it
gets its interval: the first of the pieces inside it, and how many there are. Intervals are nested sets,
so the text of an element, descendants included, is one slice of the texts of the pieces.

An end tag ends the innermost open element of its name and all inside it; one that
finds none is left out. Some start tags end elements before them (a list item the one
before). What is open at the end of the page ends there. Other rules of tree construction
are not applied.

The fold is cut into chunks, so that what it appends to stays short: its cost grows
with the pieces and not with their square.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkloom import fixed
from linkloom.functions import html as H
from linkloom.functions.binding import let
from linkloom.functions.entities import decode_entities

CHUNK = 256
#: Between an element and its text in ``elements_with_text``; cannot come from the page.
MARK = "\x02"
_TEXT, _OPEN, _OWN_TEXT, _VOID, _END, _OTHER = 0, 1, 2, 3, 4, 5
_OPENED = "struct<tag:string,at:int>"
_CLOSED = "struct<at:int,first:int,count:int>"


def without_marks(html: Column) -> Column:
    """Without the characters that mark what was found."""
    return F.when(html.rlike(r"[\x01-\x03]"), F.translate(html, "\x01\x02\x03", "")).otherwise(html)


def _kind(piece: Column, tag: Column, raw_tags: tuple[str, ...]) -> Column:
    return (
        F.when(tag == "", F.when(piece.rlike(r"\A<[!?]"), _OTHER).otherwise(_TEXT))
        .when(piece.startswith("</"), _END)
        .when(tag.isin(*raw_tags), _OWN_TEXT)
        .when(tag.isin(*fixed.VOID_TAGS), _VOID)
        .otherwise(_OPEN)
    )


def parsed_pieces(pieces: Column, raw_tags: tuple[str, ...] = fixed.RAW_TEXT_TAGS) -> Column:
    """Each piece of ``html.pieces`` as (kind, tag, text, piece)."""

    def parse(piece: Column) -> Column:
        tag = F.lower(F.regexp_extract(piece, r"\A</?([A-Za-z][^\t\n\f\r />]*)", 1))

        def parsed(p: Column) -> Column:
            kind, tag, piece = p["kind"], p["tag"], p["piece"]
            body = H.raw_body(piece)
            own = F.when(tag.isin(*fixed.DECODED_RAW_TAGS), decode_entities(body)).otherwise(body)
            text = F.when(kind == _TEXT, decode_entities(piece)).when(kind == _OWN_TEXT, own).otherwise("")
            return F.struct(kind.alias("kind"), tag.alias("tag"), text.alias("text"), piece.alias("piece"))

        named = let(F.struct(tag.alias("tag"), piece.alias("piece")), lambda p: F.struct(
            _kind(p["piece"], p["tag"], raw_tags).alias("kind"), p["tag"].alias("tag"), p["piece"].alias("piece")
        ))
        return let(named, parsed)

    return F.transform(H.complete(pieces), parse)


def piece_texts(parsed: Column) -> Column:
    """The text of each piece; those that are not text, or raw text, have none."""
    return F.transform(parsed, lambda p: p["text"])


def _last(opened: Column, wanted: Column) -> Column:
    """Place of the last open element whose name is in ``wanted``, 0 if there is none."""
    places = F.transform(opened, lambda e, i: F.when(F.array_contains(wanted, e["tag"]), i + 1).otherwise(0))
    return F.coalesce(F.array_max(places), F.lit(0))


def _implied(tag: Column, column: int) -> Column:
    """Names the start tag ends (1), or those it does not look behind (2)."""
    chosen = F.lit(None).cast("array<string>")
    for tags, *names in fixed.IMPLIED_ENDS:
        chosen = F.when(tag.isin(*tags), F.array(*[F.lit(n) for n in names[column - 1]])).otherwise(chosen)
    return chosen


def _interval(at: Column, first: Column, count: Column) -> Column:
    return F.struct(at.alias("at"), first.alias("first"), count.alias("count"))


def _step(state: Column, piece: Column) -> Column:
    """The state after one start or end tag: open elements, and ended ones of this chunk."""
    kind, tag, opened, at = piece["kind"], piece["tag"], state["opened"], piece["at"]
    ends = F.when(kind == _END, F.array(tag)).when(kind == _OPEN, _implied(tag, 1))
    behind = F.when(kind == _OPEN, _implied(tag, 2))
    found = let(
        F.when(ends.isNull() | (F.size(opened) == 0), F.lit(0)).otherwise(_last(opened, ends)),
        lambda place: F.when((place == 0) | behind.isNull(), place).when(_last(opened, behind) > place, F.lit(0)).otherwise(place),
    )

    def after(cut: Column) -> Column:
        gone = F.transform(
            F.slice(opened, cut, F.size(opened)), lambda e: _interval(e["at"], e["at"] + 1, at - e["at"] - 1)
        )
        left = F.when(cut > 0, F.slice(opened, F.lit(1), F.greatest(cut - 1, F.lit(0)))).otherwise(opened)
        entered = F.array(F.struct(tag.alias("tag"), at.alias("at")))
        closed = F.when(cut > 0, F.concat(state["closed"], gone)).otherwise(state["closed"])
        return F.struct(
            F.when(kind == _OPEN, F.concat(left, entered)).otherwise(left).alias("opened"),
            closed.alias("closed"),
        )

    return let(found, after)


def intervals(parsed: Column) -> Column:
    """(at, first, count) of each element: its place among the pieces, and those that are inside it. Places count from 0."""
    placed = F.transform(parsed, lambda p, i: F.struct(p["kind"].alias("kind"), p["tag"].alias("tag"), i.alias("at")))
    return let(placed, _intervals)


def _intervals(placed: Column) -> Column:
    # what neither opens nor ends another element does not need the fold
    alone = F.transform(
        F.filter(placed, lambda p: p["kind"].isin(_OWN_TEXT, _VOID)), lambda p: _interval(p["at"], p["at"], F.lit(1))
    )
    return let(
        F.filter(placed, lambda p: p["kind"].isin(_OPEN, _END)), lambda tags: F.concat(_folded(tags, F.size(placed)), alone)
    )


def _folded(tags: Column, size: Column) -> Column:
    """Intervals of the elements that start tags open, on a page of ``size`` pieces."""
    chunks = F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil(F.size(tags) / CHUNK).cast("int") - 1, F.lit(0))),
        lambda c: F.slice(tags, c * CHUNK + 1, CHUNK),
    )
    none = F.array().cast(f"array<{_CLOSED}>")
    begin = F.struct(
        F.array().cast(f"array<{_OPENED}>").alias("opened"), F.array().cast(f"array<array<{_CLOSED}>>").alias("done")
    )

    def chunk(state: Column, pieces: Column) -> Column:
        start = F.struct(state["opened"].alias("opened"), none.alias("closed"))
        return let(
            F.aggregate(pieces, start, _step),
            lambda s: F.struct(s["opened"].alias("opened"), F.concat(state["done"], F.array(s["closed"])).alias("done")),
        )

    def finish(state: Column) -> Column:
        left = F.transform(state["opened"], lambda e: _interval(e["at"], e["at"] + 1, size - e["at"] - 1))
        return F.concat(F.flatten(state["done"]), left)

    return F.aggregate(chunks, begin, chunk, finish)


def text_of(texts: Column, interval: Column) -> Column:
    return F.array_join(F.slice(texts, interval["first"] + 1, interval["count"]), "")


def _with(then: Callable[[Column], Column], **values: Column) -> Column:
    """``then`` of a struct of ``values``, each computed once for a page.

    Named inside a lambda, a value may be computed once for every element.
    """
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), then)


def found_in_elements(texts: Column, intervals: Column, find: Callable[[Column], Column]) -> Column:
    """What ``find`` finds in the text of each element, each once. No text is kept longer than that takes."""

    def found(page: Column) -> Column:
        return F.array_distinct(F.flatten(F.transform(page["intervals"], lambda e: find(text_of(page["texts"], e)))))

    return _with(found, texts=texts, intervals=intervals)


def elements_with_text(parsed: Column, texts: Column, intervals: Column, asked: Callable[[Column, Column], Column]) -> Column:
    """Each element as its piece, a mark, and its whole text; the text only where ``asked`` (of the piece and the text)."""

    def item(page: Column, e: Column) -> Column:
        pair = F.struct(F.get(page["pieces"], e["at"]).alias("piece"), text_of(page["texts"], e).alias("text"))
        return let(pair, lambda p: F.when(asked(p["piece"], p["text"]), F.concat(p["piece"], F.lit(MARK), p["text"])).otherwise(p["piece"]))

    return _with(
        lambda page: F.transform(page["intervals"], lambda e: item(page, e)),
        pieces=F.transform(parsed, lambda p: p["piece"]), texts=texts, intervals=intervals,
    )
