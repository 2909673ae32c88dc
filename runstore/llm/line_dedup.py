"""Line deduplication over all documents, exact and within a bound of word edits.

Lines are compared in lower case with single spaces. Of equal lines the earliest (by document id, then line number)
stays. A line also goes if an earlier one is near: at most ``max_edits`` word insertions, deletions or substitutions away,
and no more than one for each ``words_per_edit`` words of the longer of the two (a similarity of 0.8 at least). That holds
for lines of any length.

The near part is a deletion-neighbourhood join. A line emits all variants within the bound as hashed keys: with words left
out, and with words blanked in their place. Lines that share a variant, made by leaving out d and e words and blanking b in
each, are at most b + d + e edits apart, and lines within the bound share one. So a group of equal variants needs only its
earliest line for each number of words left out, never pairs. A variant's hash is an XOR of place-tagged word hashes,
so that of a line's variants comes from running XORs: one edit takes linear time for lines of any length, two edits as
many variants as a line has pairs of words. Only lines that share a stretch of words with another line (as near lines must,
one of ``max_edits`` + 1 of them) emit variants. Every link found is verified word by word before it counts. DataFrame
functions only.

Defined results: a null text stays null; rows without an id come before all others, in the order of their texts' hashes;
rows of one id with different texts are different documents in that order too; rows alike in id and text are one document,
whose lines are treated alike; an empty table gives no rows; other columns pass through whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _util

AT = ("_id", "_t", "_no")  # document id, hash of its text, line number: a line's place


@dataclass(frozen=True)
class Lines:
    max_edits: int = 1  # 0, 1 or 2
    words_per_edit: int = 5
    least_left: float = 0.2  # ``rewrite`` drops documents of whose bytes less is left: remnants of copies
    broadcast_bytes: int = 16 << 20  # line places up to this size are broadcast to fetch texts; beyond, the join shuffles

    def __post_init__(self):
        if self.max_edits not in (0, 1, 2) or self.words_per_edit < 2 * self.max_edits + 1:
            raise ValueError("max_edits is 0, 1 or 2, and words_per_edit more than twice as much")

    def allowed(self, longer: str) -> str:
        return f"least({self.max_edits}, ({longer}) div {self.words_per_edit})"


def normal(text: Column) -> Column:
    """Lower case with single spaces between words, for a line or a whole text; lines still need trimming."""
    low, odd = F.lower(text), F.contains(text, F.lit("  "))
    for c in "\t\r\f\x0b":  # the expression is costly and most texts do not need it
        odd = odd | F.contains(text, F.lit(c))
    return F.when(odd, F.regexp_replace(low, r"[ \t\r\f\x0B]+", " ")).otherwise(low)


def word_edits_within(a: Column, b: Column, most: int) -> Column:
    """Whether two word arrays are at most ``most`` insertions, deletions or substitutions apart."""
    if most == 0:
        return a == b
    na, nb = F.size(a), F.size(b)
    mismatch = F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False)
    same = F.when(mismatch > 0, mismatch.cast("int") - 1).otherwise(F.least(na, nb))  # equal words at the start

    def rest(x: Column, n: Column, skip: int) -> Column:
        return F.slice(x, same + skip + 1, F.greatest(n - same - skip, F.lit(0)))

    def then(skip_a: int, skip_b: int) -> Column:
        return word_edits_within(rest(a, na, skip_a), rest(b, nb, skip_b), most - 1)

    # A word more or less is possible only while the lengths allow it.
    return F.when(F.abs(na - nb) > most, False).otherwise(then(1, 1) | then(1, 0) | then(0, 1))


def stretches(lines: Lines) -> list[Column]:
    """Hashes of the stretches of ``line`` (``n`` words) of which near lines share one.

    Cut into ``max_edits`` + 1 parts, the shorter of two near lines has a part that no edit touches; in the longer one it
    lies as many words further as there are insertions less deletions before it.
    """
    k, out = lines.max_edits, []
    for short in range(k + 1):  # the shorter line's length is n - short
        t = f"(n - {short})"
        for part in range(k + 1):
            shifts = [0] if part == 0 else [short] if part == k else range(-((k - short) // 2), short + (k - short) // 2 + 1)
            low, high = f"{t} * {part} div {k + 1}", f"{t} * {part + 1} div {k + 1}"
            for shift in shifts:
                words = f"substring_index(line, ' ', cast({high} + {shift} as int))" if part < k else "line"
                if part:
                    words = f"substring_index({words}, ' ', -cast({high} - {low} as int))"
                out.append(F.expr(f"case when n + {0 if short else k} >= {lines.words_per_edit} then xxhash64({words}, {t}, {part}) end"))
    return out


def line_places(docs: DataFrame, id_col: str, lines: Lines) -> DataFrame:
    """Slim rows of all lines with words: their place, 128-bit key and the hashes of their stretches."""
    text = F.col("text").cast("string")
    rows = (
        docs.select(_util.col(id_col).alias("_id"), text.alias("text")).filter(F.col("text").isNotNull())
        .select("_id", _util.row_hash(F.col("text")).alias("_t"), F.posexplode(F.transform(F.split(normal(F.col("text")), "\n"), F.trim)).alias("_no", "line"))
        .filter(F.col("line") != "")
        .select("*", (F.octet_length("line") - F.octet_length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).alias("n"))
    )
    keys = [c.alias(f"s{i}") for i, c in enumerate(stretches(lines))] if lines.max_edits else []
    return rows.select(*AT, F.xxhash64("line").alias("h"), F.xxhash64(F.lit("second"), "line").alias("g"), *keys)


def _near_lines(docs: DataFrame, firsts: DataFrame, id_col: str, lines: Lines) -> DataFrame:
    """Place, key and text of the distinct lines that share a stretch with another."""
    parts = [c for c in firsts.columns if c not in (*AT, "h", "g")]
    keyed = firsts.select("h", F.explode(F.array(*parts)).alias("stretch")).filter("stretch is not null")
    shared = _util.save(keyed.groupBy("stretch").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("stretch"), "stretches")
    members = keyed.join(shared.hint("merge"), "stretch").select("h").distinct()
    places = _util.save(firsts.select(*AT, "h", "g").join(members, "h"), "near-places")
    per = places.groupBy(F.col("_id").alias("_of"), F.col("_t").alias("_of_t")).agg(F.collect_list(F.struct("_no", "h", "g")).alias("found"))
    count, size = places.agg(F.count("*"), F.sum(F.octet_length(F.col("_id").cast("string")))).first()
    if 64 * count + (size or 0) <= lines.broadcast_bytes:
        per = F.broadcast(per)
    else:
        per = _util.save(per, "near-documents")
    rows = docs.select(_util.col(id_col).alias("_id"), F.col("text").cast("string").alias("text")).filter(F.col("text").isNotNull()).withColumn("_t", _util.row_hash(F.col("text")))
    split = rows.join(per, F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_t") == F.col("_of_t"))).select("_id", "_t", "found", F.split("text", "\n").alias("parts"))
    got = split.select("_id", "_t", F.explode(F.expr("transform(found, x -> named_struct('_no', x._no, 'h', x.h, 'g', x.g, 'line', get(parts, x._no)))")).alias("x"))
    made = got.select("_id", "_t", "x._no", "x.h", "x.g", F.trim(normal(F.col("x.line"))).alias("line")).dropDuplicates(AT)
    return _util.save(made, "near-lines")


def variants(near: DataFrame, lines: Lines) -> DataFrame:
    """All variants of each line: its place and ``h``, ``d`` (words left out), ``b`` (words blanked), ``m`` (words and blanks), ``key``, ``kind``."""
    k, over = lines.max_edits, f"over (partition by {', '.join(AT)}"
    # Dealt by line before the words are taken apart, so the windows need no exchange of words.
    dealt = near.repartition(_util.partitions(near.sparkSession), *AT)
    words = dealt.select(*AT, "h", F.posexplode(F.split("line", " ")).alias("p", "w")).select(*AT, "h", "p", F.xxhash64("w").alias("w"))
    tagged = words.select(*AT, "h", "p", *[F.xxhash64("w", F.col("p") - s).alias(f"w{s}") for s in range(k + 1)])  # in its place, one before, two before
    before, whole = f"{over} order by p rows between unbounded preceding and 1 preceding)", f"{over})"
    summed = tagged.select(
        "*", F.expr(f"count(*) {whole}").cast("int").alias("n"),
        *[F.expr(f"coalesce(bit_xor(w{s}) {before}, 0L)").alias(f"a{s}") for s in range(k + 1)], *[F.expr(f"bit_xor(w{s}) {whole}").alias(f"t{s}") for s in range(k + 1)],
    )

    def variant(key: str, m: str, d: int, blanks: tuple[str, ...] = ()) -> str:
        return f"named_struct('d', {d}, 'b', {len(blanks)}, 'm', cast({m} as int), 'key', {key}, 'kind', xxhash64({', '.join([m, *blanks])}))"

    one = [variant("t0 ^ w0", "n", 0, ("p",)), variant("a0 ^ t1 ^ a1 ^ w1", "n - 1", 1)]
    made = summed.select(*AT, "h", F.explode(F.expr(f"case when p = 0 then array({variant('t0', 'n', 0)}, {', '.join(one)}) else array({', '.join(one)}) end")).alias("v"))
    if k == 2:
        per = summed.groupBy(*AT, "h", "n", "t0", "t1", "t2").agg(F.sort_array(F.collect_list(F.struct("p", "w0", "w1", "w2", "a0", "a1", "a2"))).alias("ws"))
        firm = [
            variant("t0 ^ x.w0 ^ y.w0", "n", 0, ("x.p", "y.p")),
            variant("x.a0 ^ y.a1 ^ x.a1 ^ x.w1 ^ t2 ^ y.a2 ^ y.w2", "n - 2", 2),
            variant("x.a0 ^ t1 ^ x.a1 ^ x.w1 ^ y.w1", "n - 1", 1, ("y.p - 1",)),  # x left out, y blanked
            variant("y.a0 ^ t1 ^ y.a1 ^ y.w1 ^ x.w0", "n - 1", 1, ("x.p",)),  # y left out, x blanked
        ]
        pairs = F.expr(f"flatten(flatten(transform(ws, x -> transform(slice(ws, x.p + 2, n), y -> array({', '.join(firm)})))))")
        made = made.unionByName(per.filter("n >= 2").select(*AT, "h", F.explode(pairs).alias("v")))
    return made.select(*AT, "h", "v.*")


def near_links(near: DataFrame, lines: Lines) -> DataFrame:
    """The lines (place and key) that have an earlier one within the bound, verified."""
    k, at = lines.max_edits, F.struct(*AT)
    every = _util.save(variants(near, lines), "variants")
    shared = every.groupBy("key", "kind").agg(F.min("h").alias("lo"), F.max("h").alias("hi")).filter("lo < hi").select("key", "kind")
    every = _util.save(every.join(_util.save(shared, "shared-variants").hint("merge"), ["key", "kind"]), "group-members")
    first = [F.min(F.when(F.col("d") == d, at)).alias(f"e{d}") for d in range(k + 1)]
    groups = _util.save(every.groupBy("key", "kind").agg(*first), "groups")
    # Each line of a group with the earliest of every kind that is near enough by this variant.
    near_enough = [f"if(b + d + {e} between 1 and {lines.allowed(f'm + greatest(d, {e})')}, e{e}, null)" for e in range(k + 1)]
    found = every.join(groups.hint("merge"), ["key", "kind"]).select(*AT, F.explode(F.expr(f"array({', '.join(near_enough)})")).alias("first")).filter(F.col("first") < at)
    found = found.select(*AT, *[F.col("first")[c].alias(f"o{c}") for c in AT]).distinct()
    mine = near.select(*AT, "h", "g", F.split("line", " ").alias("a"))
    other = near.select(*[F.col(c).alias(f"x{c}") for c in AT], F.split("line", " ").alias("b"))
    here = F.lit(True)
    for c in AT:
        here = here & F.col(f"o{c}").eqNullSafe(F.col(f"x{c}"))
    checked = _util.save(found, "candidates").join(other, here).join(mine.withColumnsRenamed({c: f"m{c}" for c in AT}), F.col("_id").eqNullSafe(F.col("m_id")) & (F.col("_t") == F.col("m_t")) & (F.col("_no") == F.col("m_no")))
    checked = checked.withColumn("most", F.expr(lines.allowed("greatest(size(a), size(b))")))
    right = F.lit(False)
    for e in range(1, k + 1):
        right = right | ((F.col("most") == e) & word_edits_within(F.col("a"), F.col("b"), e))
    return checked.filter(right).select("h", "g").distinct()


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", lines: Lines = Lines()) -> DataFrame:
    """Per document with such lines: ``_id``, ``_t``, ``exact`` and ``near``, the numbers of the lines that go."""
    with _util.scratch():
        return _util.save(_gone(docs, id_col, lines), "gone", stays=True)


def _gone(docs: DataFrame, id_col: str, lines: Lines) -> DataFrame:
    at = F.struct(*AT)
    places = _util.save(line_places(docs, id_col, lines), "lines")
    parts = [c for c in places.columns if c not in (*AT, "h", "g")]
    firsts = places.groupBy("h", "g").agg(F.min(at).alias("first"), F.max(at).alias("last"), *[F.first(c).alias(c) for c in parts])
    firsts = _util.save(firsts.select("h", "g", "first.*", (F.col("first") < F.col("last")).alias("again"), *parts), "first-lines")
    hit = firsts.filter("again").select("h", "g", F.struct(*AT).alias("first"))
    if lines.max_edits:
        near = _util.save(near_links(_near_lines(docs, firsts.drop("again"), id_col, lines), lines), "near-links")
        hit = hit.join(near.withColumn("near", F.lit(True)), ["h", "g"], "full_outer")
    else:
        hit = hit.withColumn("near", F.lit(False))
    # Saved, so that a line which is a third of all can be split in the join.
    going = places.select(*AT, "h", "g").join(_util.save(hit, "hits").hint("merge"), ["h", "g"])
    going = going.withColumn("exact", F.coalesce(at != F.col("first"), F.lit(False))).filter("exact or near").select(*AT, "exact")
    return going.groupBy("_id", "_t").agg(F.collect_set(F.when(F.col("exact"), F.col("_no"))).alias("exact"), F.collect_set(F.when(~F.col("exact"), F.col("_no"))).alias("near"))


def _deduped(docs: DataFrame, id_col: str, lines: Lines) -> DataFrame:
    """The caller's columns packed, ``text``, ``kept``, ``n_exact`` and ``n_near``."""
    gone = dropped_lines(docs, id_col, lines).select(F.col("_id").alias("_of"), F.col("_t").alias("_of_t"), "exact", "near")
    rows = _util.packed(docs, docs.columns, _util.col(id_col).alias("_id"), F.col("text").cast("string").alias("text")).withColumn("_t", _util.row_hash(F.col("text")))
    # Many documents lose lines, so this side grows with the corpus: never a broadcast, whatever its size here.
    joined = rows.join(gone.hint("merge"), F.col("_id").eqNullSafe(F.col("_of")) & (F.col("_t") == F.col("_of_t")), "left")
    # array_except and transform over indexes keep this linear in the number of lines.
    parts = joined.withColumn("parts", F.when(F.col("_of_t").isNotNull(), F.split("text", "\n")))
    left = F.expr("array_except(sequence(0, size(parts) - 1), concat(exact, near))")
    text = F.when(F.col("_of_t").isNull(), F.col("text")).otherwise(F.array_join(F.transform(left, lambda i: F.get(F.col("parts"), i)), "\n"))
    counts = [F.when(F.col("_of_t").isNull(), 0).otherwise(F.size(c)).cast("long").alias(f"n_{c}") for c in ("exact", "near")]
    return parts.select(_util.KEPT, "text", text.alias("kept"), *counts)


def dedup(docs: DataFrame, id_col: str = "doc_id", lines: Lines = Lines()) -> DataFrame:
    """All rows and columns of ``docs`` with ``_kept_text``, ``_n_exact``, ``_n_near`` (more underscores where taken)."""
    return _util.unpacked(_deduped(docs, id_col, lines), docs.columns, {"_kept_text": F.col("kept"), "_n_exact": F.col("n_exact"), "_n_near": F.col("n_near")})


def rewrite(docs: DataFrame, id_col: str = "doc_id", lines: Lines = Lines()) -> DataFrame:
    """``docs`` with the remaining text in ``text`` (and its length in ``n_chars``, if there); columns as before.

    Documents that lose all their words this way go, and those of which less than ``least_left`` is left: nearly all of
    their lines are in earlier documents.
    """
    made, changed = _deduped(docs, id_col, lines), F.col("n_exact") + F.col("n_near") > 0
    empty = F.trim(normal(F.replace(F.col("kept"), F.lit("\n"), F.lit(" ")))) == ""
    little = F.octet_length("kept") < lines.least_left * F.octet_length("text")
    made = made.filter(~F.coalesce(changed & (empty | little), F.lit(False)))
    new = {"text": F.col("kept").cast(docs.schema["text"].dataType)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed, F.length("kept").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(_util.KEPT)["n_chars"])
    return made.select(*[new.get(c, F.col(_util.KEPT).getField(c)).alias(c) for c in docs.columns])
