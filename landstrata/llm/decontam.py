"""Benchmark decontamination by templates.

Words lose case and punctuation, and typed placeholders take the place of numbers, of units behind a number and of names
(capitalised words inside a sentence). Windows of ``width`` template words of documents and items are hash-joined; an item
with fewer words is one window. A window also has the forms where capitalised words that open a sentence are names too,
where names are literal words, and where all words are, in lower case: a name may open a sentence, and a copy may be in
small letters or capitals throughout.

Questions are also asked anew in other words for the same slots. So windows over number words, units away from a number,
pronouns and names or number words of several words have a looser form, too: number words are numbers, words of the unit list with three
letters or more are units wherever they stand, personal pronouns are placeholders without a slot, and up to ``RUN``
number words or capitalised words in a row are one placeholder.

The values behind the placeholders are kept as slots: within one occurrence a value of the item has to become the same value
everywhere, so windows that contradict its usual replacement there are dropped; windows with the item's own values
always count. An occurrence is what lies in a row's text at one distance from the item's words; or at distances that differ by less
than half of the item's words from one to the next, for words put in or left out; or the whole document. A document is
contaminated by an item if the windows left of an occurrence cover at least ``cover`` of the item's windows. That finds
exact copies and questions that were asked anew with other numbers, names or units, also several times in a document.

Before the join a bitmap of fixed size, made from the items' window hashes, drops document windows that match none.

Defined cases: null or empty texts have no words and match nothing; repeated rows of an item count once, rows that share
an item's id are one item each; rows that repeat a document's id share their matches as one document; a null document or item id is
reported as null; other columns are ignored; empty tables give no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from landstrata.session import scratch_path

from . import _text

U = np.uint64
#: Units of measure and money that a number may carry.
UNITS = (
    "mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg t ton tons tonne tonnes gram grams kilogram kilograms "
    "oz ounce ounces lb lbs pound pounds ml cl l liter liters litre litres gallon gallons pint pints cup cups s sec second seconds "
    "min minute minutes h hr hour hours day days week weeks month months year years ms hz khz mhz ghz w kw v a j kj cal kcal n pa k c f "
    "degree degrees percent cent cents dollar dollars usd euro euros eur pence gbp yen b kb mb gb tb mph kmh "
    "millimeter millimeters millimetre millimetres centimeter centimeters centimetre centimetres meter meters metre metres "
    "kilometer kilometers kilometre kilometres milliliter milliliters millilitre millilitres milligram milligrams acre acres hectare hectares "
    "meile meilen stunde stunden minuten tag tage tagen woche wochen monat monate jahr jahre gramm kilogramm pfund prozent "
    "heure heures jour jours semaine semaines mois années mètre mètres kilomètre kilomètres gramme grammes litro litros "
    "hora horas minuto minutos día días semana semanas mes meses años metro metros kilómetro kilómetros gramo gramos"
).split()

#: Number words and fractions of English, German, French and Spanish, without the articles.
NUMBER_WORDS = (
    "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty "
    "thirty forty fifty sixty seventy eighty ninety hundred thousand million half third quarter dozen "
    "null eins zwei drei vier fünf sechs sieben acht neun zehn elf zwölf dreizehn vierzehn fünfzehn sechzehn siebzehn achtzehn neunzehn zwanzig "
    "dreißig vierzig fünfzig sechzig siebzig achtzig neunzig hundert tausend millionen halb hälfte drittel viertel dutzend "
    "zéro deux trois quatre cinq sept huit neuf dix onze douze treize quatorze quinze seize vingt trente quarante cinquante soixante mille "
    "moitié tiers quart douzaine "
    "cero uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece catorce quince dieciséis diecisiete dieciocho diecinueve veinte "
    "treinta cuarenta cincuenta sesenta setenta ochenta noventa cien ciento mil millón mitad tercio cuarto docena"
).split()
#: Pronouns that change with a name.
PRONOUNS = "he she they him her them his hers their theirs himself herself themselves er sie ihm ihn ihr ihre sein seine il elle lui él ella".split()

RUN = 3  # words that one placeholder of the looser form stands for, at most
BITS = 22  # of the bitmap's address
PART = 1 << 18  # bytes of text taken at once: all forms of their windows are in memory together
_ASCII_WORD = np.zeros(256, bool)
_ASCII_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;\n\"("]] = True
NUMBER, UNIT, NAME, PRONOUN = (U(_text.mix_int(9000 + i)) for i in range(4))


def _word_hashes(words: list[str]) -> np.ndarray:
    words = [w.encode() for w in words]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    return np.sort(_text.hash_runs(data, np.concatenate([[0], ends[:-1]]), ends))


def _among(hashes: np.ndarray, words: np.ndarray) -> np.ndarray:
    return words[np.minimum(np.searchsorted(words, hashes), len(words) - 1)] == hashes


def template(data: np.ndarray, offsets: np.ndarray):
    """(hash, kind, start, end, row, literal) of each template word; kind 0: literal, else 1 number, 2 unit, 3 name."""
    return _template(data, offsets)[:6]


def _template(data: np.ndarray, offsets: np.ndarray):
    """The columns of ``template``, and whether a literal word is capitalised and opens a sentence."""
    digit, member = _DIGIT[data], _ASCII_WORD[data]
    n = len(data)
    if n > 2:  # a point or comma between digits belongs to the number
        inside = np.zeros(n, bool)
        inside[1:-1] = ((data[1:-1] == 46) | (data[1:-1] == 44)) & digit[:-2] & digit[2:]
        member, digit = member | inside, digit | inside
    breaks = np.zeros(n, bool)
    if n:
        breaks[1:] = member[1:] & member[:-1] & (digit[1:] != digit[:-1])  # "5kg" is a number and a unit
    start, end, row = _text.runs(member, offsets, breaks)
    hashes = _text.hash_runs(_text.LOWER[data], start, end)
    kind = np.zeros(len(start), np.int8)
    literal = hashes.copy()
    if not len(start):
        return hashes, kind, start, end, row, literal, np.zeros(0, bool)
    kind[digit[start]] = 1
    after_number = np.zeros(len(start), bool)
    after_number[1:] = (kind[:-1] == 1) & (row[1:] == row[:-1])
    kind[after_number & _among(hashes, _word_hashes(UNITS)) & (kind == 0)] = 2
    # a capital (ASCII, or the second byte of a Latin-1 capital) not at the start of a sentence
    second = data[np.minimum(start + 1, n - 1)]
    capital = _CAPITAL[data[start]] | ((data[start] == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    solid = data != 32
    last_solid = np.maximum.accumulate(np.where(solid, np.arange(n), -1))
    previous = np.where(start > 0, last_solid[np.maximum(start - 1, 0)], -1)
    opening = (previous < offsets[row]) | _STOP[data[np.maximum(previous, 0)]]
    kind[capital & ~opening & (kind == 0)] = 3
    for i, mark in enumerate((NUMBER, UNIT, NAME), 1):
        hashes[kind == i] = mark
    return hashes, kind, start, end, row, literal, capital & opening & (kind == 0)


def _windows(hashes: np.ndarray, row: np.ndarray, width: int):
    """(sum before scrambling, first word) of all windows of ``width`` words within a row."""
    m = max(0, len(hashes) - width + 1)
    total = np.full(m, U(_text.mix_int(width)), U)
    for i in range(width):
        total += hashes[i : i + m] * U(_text.mix_int(31 + i) | 1)
    inside = np.flatnonzero(row[:m] == row[width - 1 : width - 1 + m]) if m else np.empty(0, np.int64)
    return total[inside], inside


def _forms(words, width: int, of_items: bool):
    """(hash, first word, kinds) of the windows in each form; forms in which a window says the same as in another leave it out.

    In documents a window that starts with a name also has that word itself: an item's first word has its capital also
    where the item stands inside a sentence.
    """
    hashes, kind, _, _, row, literal, opens = words
    total, first = _windows(hashes, row, width)
    yield _text.mix(total).view(np.int64), first, kind

    def holds(mark):  # windows with such a word
        before = np.concatenate([[0], np.cumsum(mark)])
        return before[first + width] > before[first]

    def other(keep, kinds):
        values = literal.copy()
        for i, mark in enumerate((NUMBER, UNIT, NAME), 1):
            values[kinds == i] = mark
        return _text.mix(_windows(values, row, width)[0][keep]).view(np.int64), first[keep], kinds

    name = kind == 3
    if not of_items:
        again = first[name[first]]
        second = total[name[first]] + (literal[again] - hashes[again]) * U(_text.mix_int(31) | 1)
        yield _text.mix(second).view(np.int64), again, None
    yield other(holds(opens), np.where(opens, np.int8(3), kind))
    yield other(holds(name), np.where(name, np.int8(0), kind))
    yield other(holds((kind == 1) | (kind == 2)), np.zeros_like(kind))


def _loose(data: np.ndarray, words, opening: bool):
    """(hash, kind, start, end, row, place, needed) of the placeholders and words of the looser form; ``opening``: with
    capitalised words that open a sentence as names.

    ``place`` is the place of the first word among the template words; ``needed`` are the counts, up to each place, of what a window has to
    hold for this form to say something else than the others.
    """
    _, kind, start, end, row, literal, opens = words
    n = len(kind)
    spelt = _among(literal, _word_hashes(NUMBER_WORDS)) & ((kind == 0) | (kind == 3))
    loose = np.where(spelt, np.int8(1), kind)
    number = loose == 1
    behind = np.zeros(n, bool)
    behind[1:] = number[:-1] & (row[1:] == row[:-1])
    unit = _among(literal, _word_hashes([u for u in UNITS if len(u) >= 3])) | (behind & _among(literal, _word_hashes(UNITS)))
    loose[unit & (loose == 0)] = 2
    loose[_among(literal, _word_hashes(PRONOUNS)) & (loose == 0)] = 4
    opened = opens & (loose == 0) if opening else np.zeros(n, bool)
    loose[opened] = 3
    changed = (loose != kind) & ~opened
    # words of one run stand beside each other with one byte between them
    joins = np.zeros(n, bool)
    side = (row[1:] == row[:-1]) & (start[1:] == end[:-1] + 1) & (loose[1:] == loose[:-1])
    gap = data[np.minimum(end[:-1], max(len(data) - 1, 0))]
    joins[1:] = side & ((gap == 32) | (gap == 45)) & ((spelt[1:] & spelt[:-1]) | (loose[1:] == 3))
    firsts = np.maximum.accumulate(np.where(joins, 0, np.arange(n)))
    head = np.flatnonzero((np.arange(n) - firsts) % RUN == 0)
    size = np.diff(np.concatenate([head, [n]]))
    last = head + size - 1
    hashes = literal[head].copy()
    for i, mark in enumerate((NUMBER, UNIT, NAME, PRONOUN), 1):
        hashes[loose[head] == i] = mark
    sums = np.concatenate([[0], np.cumsum(changed)])
    new = (sums[last + 1] > sums[head]) | (size > 1)
    sums = np.concatenate([[0], np.cumsum(opened)])
    names = sums[last + 1] > sums[head]
    needed = [np.concatenate([[0], np.cumsum(x)]) for x in ((new, names) if opening else (new,))]
    return hashes, loose[head], start[head], end[last], row[head], head, needed


def _streams(data: np.ndarray, offsets: np.ndarray, widths, of_items: bool):
    """For the words as they are and in both looser forms: (kind, start, end, row, place, [(width, hash, first, kinds)])."""
    words = _template(data, offsets)
    _, kind, start, end, row, _, _ = words
    plain = ((width, *form) for width in widths for form in _forms(words, width, of_items))
    yield kind, start, end, row, np.arange(len(kind)), plain
    if not len(kind):
        return
    for opening in (False, True):
        hashes, kind, start, end, row, place, needed = _loose(data, words, opening)

        def looser():
            for width in widths:
                total, first = _windows(hashes, row, width)
                keep = np.ones(len(first), bool)
                for sums in needed:
                    keep &= sums[first + width] > sums[first]
                yield width, _text.mix(total[keep]).view(np.int64), first[keep], kind

        yield kind, start, end, row, place, looser()


def _slots(data: bytes, kind, start, end, first: int, width: int, plain: bool) -> list[str]:
    at = range(first + plain, first + width)
    return [f"{kind[i]}{data[start[i]:end[i]].decode('utf8', 'replace').lower()}" for i in at if 0 < kind[i] < 4]


def _window_rows(column: int, widths, bitmap: np.ndarray | None, whole_only: int | None):
    """mapInArrow function: (the other columns, hash, place, slots) of windows; ``whole_only``: shorter rows are one window."""
    def run(batches):
        for batch in batches:
            for at, data, offsets in _text.slices(batch.column(column), PART):
                raw = data.tobytes()
                out_row, out_hash, out_place, out_slots = [], [], [], []
                origin = None  # the place of each row's first word
                for kind, start, end, row, place, windows in _streams(data, offsets, widths, whole_only is not None):
                    if origin is None:
                        origin = np.searchsorted(row, np.arange(len(offsets)))
                    length = np.bincount(row, minlength=len(offsets))
                    for width, found, first, kinds in windows:
                        keep = np.ones(len(first), bool)
                        if whole_only and width < whole_only:
                            keep = length[row[first]] == width
                        if bitmap is not None:
                            cell = found.view(U) >> U(64 - BITS)
                            keep &= (bitmap[(cell >> U(3)).astype(np.int64)] >> (cell & U(7)).astype(np.uint8) & 1).astype(bool)
                        found, first = found[keep], first[keep]
                        for h, f in zip(found.tolist(), first.tolist()):
                            r = int(row[f])
                            out_row.append(r)
                            out_hash.append(h)
                            out_place.append(int(place[f]) - int(origin[r]))
                            out_slots.append(_slots(raw, kind if kinds is None else kinds, start, end, f, width, kinds is None))
                if out_row:
                    others = [batch.column(i).slice(at, len(offsets) - 1).take(pa.array(out_row)) for i in range(batch.num_columns) if i != column]
                    yield pa.RecordBatch.from_arrays(
                        [*others, pa.array(out_hash, pa.int64()), pa.array(out_place, pa.int32()), pa.array(out_slots, pa.list_(pa.string()))],
                        [*[batch.schema.names[i] for i in range(batch.num_columns) if i != column], "hash", "place", "slots"])
            _text.give_back()

    return run


def contaminated(docs: DataFrame, items: DataFrame, width: int = 8, cover: float = 0.5, doc: str = "doc_id", text: str = "text",
                 item: str = "item_id", item_text: str = "text") -> DataFrame:
    """``doc_id, item_id, windows, matched, changed``: contaminated documents, with the item's windows and, of the
    occurrence that has most of them, those found and the number of slots of which the value differs."""
    asked = items.select(F.col(item).alias("item_id"), F.col(item_text).alias("text")).distinct()
    asked = asked.select("item_id", F.xxhash64("text").alias("item_key"), "text")
    of_items = asked.mapInArrow(_window_rows(2, range(1, width + 1), None, width), _schema("item_id " + asked.schema["item_id"].dataType.simpleString() + ", item_key bigint"))
    of_items = of_items.withColumnsRenamed({"slots": "item_slots"})
    # cells of a bitmap of fixed size, whatever the number of items; and the few widths below ``width``
    cells = of_items.select(F.shiftrightunsigned("hash", 64 - BITS).alias("cell")).distinct()
    bitmap = np.zeros(1 << (BITS - 3), np.uint8)
    octets = cells.groupBy(F.shiftright("cell", 3).alias("octet")).agg(F.expr("bit_or(shiftleft(1, cast(cell % 8 AS int)))").alias("bits"))
    for r in octets.collect():  # 2**(BITS - 3) rows at most
        bitmap[r["octet"]] = r["bits"]
    total = of_items.groupBy(F.col("item_key").alias("_k"), F.col("item_id").alias("_i")).agg(F.countDistinct("place").alias("windows"))
    of_items = of_items.join(total, F.col("item_key").eqNullSafe(F.col("_k")) & F.col("item_id").eqNullSafe(F.col("_i"))).drop("_k", "_i")
    widths = sorted({min(width, r[0]) for r in asked.mapInArrow(_lengths(2, width), "n int").distinct().collect()} - {0})

    names = docs.select(F.col(doc).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_key"))
    of_docs = names.mapInArrow(
        _window_rows(1, widths, bitmap, None), _schema("doc_id " + names.schema["doc_id"].dataType.simpleString() + ", text_key bigint"))
    of_docs = of_docs.withColumnRenamed("place", "doc_place")
    pair = ["doc_id", "item_id", "item_key"]
    met = of_docs.join(of_items, "hash").withColumn("shift", F.col("doc_place") - F.col("place"))
    by_shift = Window.partitionBy(*pair, "text_key").orderBy("shift")
    far = 2 * (F.col("shift") - F.lag("shift").over(by_shift)) >= F.col("windows") + (width - 1)
    met = met.withColumn("far", F.coalesce(far.cast("int"), F.lit(0))).withColumn("chain", F.sum("far").over(by_shift))
    path = scratch_path(docs.sparkSession, "windows")
    met.select(*pair, "text_key", "shift", "chain", "place", "slots", "item_slots", "windows").write.parquet(path)

    def scope(i, *at):
        return F.struct(F.lit(i).alias("i"), *[x.cast("bigint").alias(n) for n, x in zip(("text_key", "at"), at)])

    scopes = F.array(scope(0, F.col("text_key"), F.col("shift")), scope(1, F.col("text_key"), F.col("chain")), scope(2, F.lit(0), F.lit(0)))
    met = docs.sparkSession.read.parquet(path).withColumn("scope", F.explode(scopes))
    group = [*pair, "scope"]
    both = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b"))
    # for each value of the item, the value that most windows of this occurrence have in its place
    slots = met.select(*group, "place", F.explode(both).alias("s")).select(*group, "place", F.col("s.a").alias("a"), F.col("s.b").alias("b"))
    usual = slots.groupBy(*group, "a", "b").agg(F.size(F.collect_set("place")).alias("n")).groupBy(*group, "a").agg(F.max(F.struct("n", "b"))["b"].alias("b"))
    chosen = usual.groupBy(*[F.col(c).alias("_" + c) for c in group]).agg(F.map_from_entries(F.collect_list(F.struct("a", "b"))).alias("chosen"))
    same_group = F.lit(True)
    for c in group:
        same_group = same_group & F.col(c).eqNullSafe(F.col("_" + c))
    joined = met.join(chosen, same_group, "left")
    agrees = F.forall(both, lambda s: F.element_at("chosen", s["a"]) == s["b"])
    changes = F.transform(F.filter(both, lambda s: s["a"] != s["b"]), lambda s: s["a"])
    kept = joined.filter((F.col("slots") == F.col("item_slots")) | agrees).withColumn("changes", changes).groupBy(*group).agg(
        F.size(F.collect_set("place")).cast("bigint").alias("matched"), F.first("windows").alias("windows"),
        F.size(F.array_distinct(F.flatten(F.collect_set("changes")))).cast("bigint").alias("changed"))
    best = F.max(F.struct("matched", (-F.col("changed")).alias("kept"), "windows"))
    found = kept.filter(F.col("matched") >= cover * F.col("windows")).groupBy("doc_id", "item_id").agg(best.alias("best"))
    return found.select("doc_id", "item_id", F.col("best.windows").alias("windows"), F.col("best.matched").alias("matched"), (-F.col("best.kept")).alias("changed"))


def _schema(names: str) -> str:
    return f"{names}, hash bigint, place int, slots array<string>"


def _lengths(column: int, width: int):
    def run(batches):
        for batch in batches:
            for _, data, offsets in _text.slices(batch.column(column), PART):
                for _, _, _, row, _, _ in _streams(data, offsets, (), True):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(np.bincount(row, minlength=len(offsets) - 1), width).astype(np.int32))], ["n"])

    return run
