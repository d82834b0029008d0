"""Crossword search: candidates of a slot as bits, crossings as masks of letters, all boards a level at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of a word of a set; the sign bit and one more stay free.
WIDE = 62


def _bit(i: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.cast("int"))


def _words(n: Column) -> Column:
    return F.sequence(F.lit(0), F.greatest(F.ceil(n / WIDE).cast("int") - 1, F.lit(0)))


def slot_sets(candidates: DataFrame, board: str, lengths: dict[str, int]) -> DataFrame:
    """(board, slot, words, scores, every, masks): of each slot its candidates, best score first, then by word; every: the set of all of them; masks: for place and letter, as `2e`, the set of those with that letter there. Candidates (board, slot, word, score) of another length than their slot's are left out, of repeated ones the highest score counts. A slot's candidates are one row: they are a puzzle's, not a corpus's."""
    size = F.create_map(*[F.lit(x) for kv in lengths.items() for x in kv])
    c = candidates.where(F.length("word") == F.try_element_at(size, F.col("slot"))).groupBy(board, "slot", "word").agg(F.max("score").alias("score"))
    c = c.groupBy(board, "slot").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "word"))).alias("c"))
    words = F.transform("c", lambda x: x["word"])
    c = c.select(board, "slot", words.alias("words"), F.transform("c", lambda x: -x["s"]).alias("scores"))
    join = lambda bits: F.aggregate(bits, F.lit(0).cast("long"), lambda a, x: a.bitwiseOR(x))
    part = lambda w: F.slice("words", w * WIDE + 1, F.lit(WIDE))
    every = F.transform(_words(F.size("words")), lambda w: join(F.transform(part(w), lambda x, i: _bit(i))))

    def masks(k: int) -> Column:
        letter = lambda x: F.substring(x, k + 1, 1)
        there = lambda c: F.transform(_words(F.size("words")), lambda w: join(F.transform(part(w), lambda x, i: F.when(letter(x) == c, _bit(i)).otherwise(F.lit(0).cast("long")))))
        return F.transform(F.array_distinct(F.transform("words", letter)), lambda c: F.struct(F.concat(F.lit(str(k)), c), there(c)))

    longest = max(lengths.values())
    return c.select("*", every.alias("every"), F.map_from_entries(F.flatten(F.array(*[masks(k) for k in range(longest)]))).alias("masks"))


def fills(sets: DataFrame, board: str, slots: dict[str, list[int]], max_per_state: int | None = None, total_states: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(board, fill, score, depth, complete): what the search ends at, as arrays of words in the order of slots; score: the sum of theirs. complete: all slots are filled; else no candidate fits the next slot. Search goes on after either, as a depth-first search that records its terminals does.

    slots: each slot's cells, in the order in which they are filled; cells that two slots share must agree. sets: slot_sets() of the boards. max_per_state: candidates that are tried of each state, the first that fit. total_states: states of a board that count, in depth-first order. Boards without candidates for the first slot end there at once, with an empty fill, if any of their slots has some; others have no rows.

    A level is one join of the states with their board's next slot. A state's candidates are the AND of the masks of the letters that cross it, so states that can't be filled are never made.
    """
    names, seen = list(slots), []
    none = F.array().cast("array<int>")
    state = sets.select(board).distinct().select(board, F.array().cast("array<string>").alias("fill"), F.lit(0.0).alias("score"), none.alias("_order"), F.lit(False).alias("_end"))
    for t, name in enumerate(names):
        here = sets.where(F.col("slot") == name).select(F.col(board).alias("_b"), "words", "scores", "every", "masks")
        bits = F.col("every")
        for k, cell in enumerate(slots[name]):
            for p in range(t):
                if cell in slots[names[p]]:
                    letter = F.substring(F.get("fill", F.lit(p)), slots[names[p]].index(cell) + 1, 1)
                    bits = F.zip_with(bits, F.try_element_at("masks", F.concat(F.lit(str(k)), letter)), lambda a, b: a.bitwiseAND(b))
        of_word = lambda w, i: F.filter(F.transform(F.sequence(F.lit(0), F.lit(WIDE - 1)), lambda b: F.when(w.bitwiseAND(_bit(b)) != 0, i * WIDE + b)), lambda x: x.isNotNull())
        fit = F.coalesce(F.flatten(F.transform(bits, of_word)), none)
        fit = F.when(F.col("_end"), none).otherwise(fit if max_per_state is None else F.slice(fit, 1, max_per_state))
        # what ends stays as it is, so that one chain of joins tells ends and states
        j = state.join(here, F.col(board) == F.col("_b"), "left").withColumn("_fit", fit)
        on = F.col("_i") >= 0
        state = j.select(board, "fill", "score", "_order", "words", "scores", F.posexplode(F.when(F.size("_fit") > 0, F.col("_fit")).otherwise(F.array(F.lit(-1)))).alias("_n", "_i"))
        state = state.select(
            board, F.when(on, F.array_append("fill", F.get("words", F.col("_i")))).otherwise(F.col("fill")).alias("fill"), F.when(on, F.col("score") + F.get("scores", F.col("_i"))).otherwise(F.col("score")).alias("score"),
            F.when(on, F.array_append("_order", F.col("_n"))).otherwise(F.col("_order")).alias("_order"), (~on).alias("_end"),
        )
        if keep:
            state = state.where("_end").unionByName(keep(state.where("not _end").drop("_end")).withColumn("_end", F.lit(False)))
        seen.append(state.where("not _end").select(board, "_order"))
    out = state.select(board, "fill", "score", "_order", (~F.col("_end")).alias("complete"))
    if total_states is not None:
        states = seen[0]
        for more in seen[1:]:
            states = states.unionByName(more)
        within = states.withColumn("_r", F.row_number().over(Window.partitionBy(board).orderBy("_order"))).where(F.col("_r") <= total_states).select(board, "_order")
        out = out.where(F.size("_order") == 0).unionByName(out.where(F.size("_order") > 0).join(within, [board, "_order"], "left_semi"))
    return out.select(board, "fill", "score", F.size("fill").alias("depth"), "complete")


def counted(candidates: DataFrame, board: str, slots: dict[str, list[int]]) -> DataFrame:
    """(board, n_fills, score, fill): of each board that can be filled how many ways there are to fill it, and the one of highest score, the first in the alphabet on ties. candidates and slots as for slot_sets() and fills(); nothing is enumerated.

    Words of a slot that agree in the cells that other slots share are one: their number, and the best of them. Slots are joined in turn, and what is filled so far is summed over all cells that no later slot shares, so that a board has no more rows than letters in its open cells have patterns, nor than pairs of its words.
    """
    names = list(slots)
    size = F.create_map(*[F.lit(x) for name, cells in slots.items() for x in (name, len(cells))])
    c = candidates.where(F.length("word") == F.try_element_at(size, F.col("slot"))).groupBy(board, "slot", "word").agg(F.max("score").alias("score"))
    state, before = None, []
    for t, name in enumerate(names):
        others = {x for o in names if o != name for x in slots[o]}
        mine = [x for x in slots[name] if x in others]
        letter = lambda x: F.substring("word", slots[name].index(x) + 1, 1).alias(f"_{x}")  # noqa: E731, B023
        best = F.min(F.struct((-F.col("score")).alias("s"), F.array("word").alias("f")))
        words = c.where(F.col("slot") == name).select(board, "word", "score", *[letter(x) for x in mine])
        words = words.groupBy(board, *[f"_{x}" for x in mine]).agg(F.count("*").alias("_m"), best.alias("_w"))
        if state is None:
            state = words.withColumnRenamed("_m", "_n").withColumnRenamed("_w", "_f")
            before = mine
            continue
        same = [x for x in mine if x in before]
        j = state.join(words, [board, *[f"_{x}" for x in same]])
        later = {x for o in names[t + 1 :] for x in slots[o]}
        before = [x for x in dict.fromkeys([*before, *mine]) if x in later]
        both = F.struct((F.col("_f.s") + F.col("_w.s")).alias("s"), F.concat("_f.f", "_w.f").alias("f"))
        state = j.groupBy(board, *[f"_{x}" for x in before]).agg(F.sum(F.col("_n") * F.col("_m")).alias("_n"), F.min(both).alias("_f"))
    return state.select(board, F.col("_n").alias("n_fills"), (-F.col("_f.s")).alias("score"), F.col("_f.f").alias("fill"))
