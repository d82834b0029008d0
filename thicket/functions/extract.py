"""Answers out of text, as Column functions. No match gives null unless said otherwise."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The patterns that define each answer form.
PATTERNS = {
    "answer_number": r"^.*The answer is .*?([ $.0-9,\-=]+).*\..*",
    "answer_number_dotall": r"(?s)^.*[Tt]he answer is .*?([ $.0-9,\-]+).*\..*",
    "answer_number_line": r"^.*[Tt]he answer is .*?([ $.0-9,\-=]+).*\..*",
    "gold": r"(?s)#### ([^\n]*)$",
    "gold_number": r"#### (\-?[0-9\.\,]+)",
    "gold_letters": r"#### ([a-zA-Z]+)",
    "letter_strict": r"(?s)^.*[Tt]he answer is ([A-E])",
    "letter_loose": r"(?s)^.*[Tt]he answer is.*?([A-E])",
    "answer_free": r"^.*[Tt]he answer is (.*)",
    "answer_closed": r"^.*So the answer is (.*)\.$",
    "answer_word": r"(?i)the answer is (\w+)",
    "answer_label": r"Answer:\s*(.*)",
    "finish": r"Finish\[(.*?)\]",
    "number": r"-?[0-9]+(?:\.[0-9]+)?",
}
CHOICE_TAGS = [r"<answer>\s*([A-Z])\..*?</answer>", r"<answer>\s*([A-Z])\s*</answer>", r"<([A-Z])>"]


def matched(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one (an empty group stays empty)."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def final_number(text: Column, form: str = "answer_number") -> Column:
    """The number after "the answer is": signs, commas and spaces dropped, and of an equation the part after the last equals sign. Forms without DOTALL see the first line alone."""
    return F.substring_index(F.translate(matched(text, PATTERNS[form]), ", $", ""), "=", -1)


def gold_answer(text: Column, squeeze: bool = True) -> Column:
    """What follows the last gold marker."""
    gold = F.when(text.contains("#### "), F.substring_index(text, "#### ", -1))
    gold = F.when(~gold.contains("\n"), gold)
    return F.translate(gold, ", ", "") if squeeze else gold


def marked_number(text: Column) -> Column:
    """The number after the first gold marker without commas, else the sentinel `[invalid]`."""
    return F.coalesce(F.translate(matched(text, PATTERNS["gold_number"]), ",", ""), F.lit("[invalid]"))


def choice_letter(text: Column, strict: bool = False) -> Column:
    return matched(text, PATTERNS["letter_strict" if strict else "letter_loose"])


def choice_tag(text: Column) -> Column:
    """The letter of the first of three tag forms that occurs."""
    return F.coalesce(*[matched(text, p) for p in CHOICE_TAGS])


def last_choice(text: Column) -> Column:
    """The last A to E that stands alone."""
    found = F.regexp_extract_all(text, F.lit(r"\b([A-E])\b"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def yes_no(text: Column) -> Column:
    """The first line after the last "So the answer is" without dots; else `no` if a negative word occurs, else empty."""
    tail = F.replace(F.trim(F.substring_index(F.substring_index(text, "So the answer is", -1), "\n", 1)), F.lit("."), F.lit(""))
    negative = F.lit(False)
    for w in (" not ", " no ", "Not ", "No "):
        negative = negative | text.contains(w)
    return F.when(text.contains("So the answer is"), F.trim(tail)).when(negative, "no").otherwise("")


def parsed_answer(text: Column) -> Column:
    """The word after "the answer is"; else yes, no or empty by the words that occur."""
    low = F.lower(text)
    return F.when(text.rlike(PATTERNS["answer_word"]), F.lower(F.regexp_extract(text, PATTERNS["answer_word"], 1))).when(low.contains("yes") | low.contains("true"), "yes").when(low.contains("no") | low.contains("false"), "no").otherwise("")


def labelled_answer(text: Column) -> Column:
    """What follows `Answer:`, else the whole text."""
    return F.coalesce(F.nullif(matched(text, PATTERNS["answer_label"]), F.lit("")), text)


def lettered_gold(text: Column) -> Column:
    """The letters after the first gold marker."""
    return matched(text, PATTERNS["gold_letters"])


def free_answer(text: Column) -> Column:
    """What follows "the answer is" on the first line."""
    return matched(text, PATTERNS["answer_free"])


def closed_answer(text: Column) -> Column:
    """What stands between "So the answer is" and the dot that ends the first line."""
    return matched(text, PATTERNS["answer_closed"])


def finished(text: Column) -> Column:
    """The argument of the first Finish[...]."""
    return matched(text, PATTERNS["finish"])


def wide_answer(text: Column) -> Column:
    """A free-form answer: letters, digits and signs after "the answer is", up to the last dot, spaces, commas and dollar signs dropped."""
    found = matched(text, r"(?s)^.*[Tt]he answer is .*?([ $.0-9,\-=A-Za-z/]+)\.")
    return F.translate(found, ", $", "")


def confidence_section(text: Column, heading: str = "Confidence score") -> Column:
    """struct(body, score): what stands before the heading, and the first number after it."""
    there = text.contains(heading)
    score = F.when(there, F.regexp_extract(F.substring_index(text, heading, -1), r"([0-9]*\.?[0-9]+)", 1).try_cast("double"))
    return F.struct(F.regexp_replace(F.substring_index(text, heading, 1), r"^\s+|\s+$", "").alias("body"), score.alias("score"))


def overall_question(example: Column) -> Column:
    """The last sentence of a word problem, its first letter upper-case: what is asked in the end."""
    asked = matched(F.trim(example), r"(?s)^.*[.,] ([^.,]+[?.])$")
    return F.coalesce(F.concat(F.upper(F.substring(asked, 1, 1)), F.substr(asked, F.lit(2))), example)


def unescaped_argument(call: Column) -> Column:
    """The quoted argument of a call, with its escaped quotes and line ends written out; null without one."""
    found = matched(call, r"(?s)\(\s*['\"](.*)['\"]\s*\)")
    return F.replace(F.replace(F.replace(found, F.lit("\\'"), F.lit("'")), F.lit('\\"'), F.lit('"')), F.lit("\\n"), F.lit("\n"))


def repaired_yaml(text: Column) -> Column:
    """Lines `key: value` whose value holds a colon or a quote get the value quoted, so that a parser takes it as text."""
    return F.regexp_replace(text, r"(?m)^(\s*[A-Za-z_]+): ([^'\"|>\[{\n][^\n]*: [^\n]*)$", "$1: '$2'")


def yaml_field(text: Column, key: str) -> Column:
    """The value of a top-level key in simple YAML, without quotes around it; null without the key."""
    value = matched(repaired_yaml(text), rf"(?m)^{key}: *(.*)$")
    return F.regexp_replace(value, "^['\"](.*)['\"]$", "$1")


def unescaped(text: Column) -> Column:
    """Backslash sequences of quotes, tabs and line ends as what they stand for."""
    for mark, to in (("\\n", "\n"), ("\\t", "\t"), ("\\'", "'"), ('\\"', '"')):
        text = F.replace(text, F.lit(mark), F.lit(to))
    return text


def first_token_confidence(tokens: Column, accepted: list[str]) -> Column:
    """Of the first token's candidates (struct(token, log_prob)) the probability of the accepted ones, upper and lower case and spaces alike."""
    ok = F.filter(tokens, lambda t: F.lower(F.trim(t["token"])).isin([a.lower() for a in accepted]))
    return F.aggregate(ok, F.lit(0.0), lambda s, t: s + F.exp(t["log_prob"]))


def plain_entry(text: Column) -> Column:
    """Lower case, commas inside numbers and punctuation dropped, spaces squeezed."""
    t = F.regexp_replace(F.lower(text), r"([0-9]),([0-9])", "$1$2")
    return F.trim(F.regexp_replace(F.regexp_replace(t, r"[^\w\s]", ""), r"\s+", " "))


def without_banned(text: Column, banned: list[str]) -> Column:
    """Whether none of the words, split at white space, is a banned one; upper and lower case alike."""
    return ~F.arrays_overlap(F.split(F.lower(text), r"\s+"), F.array(*[F.lit(b.lower()) for b in banned]))


def last_number(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({PATTERNS['number']})"), F.lit(1))
    return F.when(F.size(found) > 0, F.element_at(found, -1))


def boxed(text: Column) -> Column:
    r"""The content of the last \boxed{...}, braces balanced; null if there is none or it doesn't close. Folds over the characters after the mark."""
    tail = F.when(text.contains("\\boxed{"), F.substring_index(text, "\\boxed{", -1))
    start = F.struct(F.lit(1).alias("depth"), F.lit("").alias("out"))

    def step(a: Column, c: Column) -> Column:
        depth = a["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)
        return F.when(a["depth"] == 0, a).otherwise(F.struct(depth.alias("depth"), F.when(depth == 0, a["out"]).otherwise(F.concat(a["out"], c)).alias("out")))

    return F.aggregate(F.split(tail, ""), start, step, lambda a: F.when(a["depth"] == 0, a["out"]))


def tagged(text: Column, key: str) -> Column:
    """All contents of <key>...</key>, in order."""
    return F.regexp_extract_all(text, F.lit(f"(?s)<{key}>(.*?)</{key}>"), F.lit(1))


def validated_tags(text: Column, keys: Sequence[str]) -> Column:
    """struct(value map, valid, message): exactly one of each tag is wanted."""
    found = [(k, tagged(text, k)) for k in keys]
    trouble = F.concat_ws("; ", *[F.when(F.size(v) == 0, f"missing {k}").when(F.size(v) > 1, f"several {k}") for k, v in found])
    value = F.create_map(*[x for k, v in found for x in (F.lit(k), F.get(v, 0))])
    return F.struct(value.alias("value"), (trouble == "").alias("valid"), trouble.alias("message"))


def so_steps(text: Column) -> Column:
    """Of the sentences that hold `So `, what follows it, one a line."""
    return F.array_join(F.transform(F.filter(F.split(text, r"\. "), lambda s: s.contains("So ")), lambda s: F.substring_index(s, "So ", -1)), "\n")


def gold_chain(chain: Column) -> Column:
    """Every second element from the third on."""
    return F.filter(chain, lambda x, i: (i >= 2) & (i % 2 == 0))


def solution_steps(text: Column) -> Column:
    """The steps of a solution written as `Step 1: ..`, `## Step 2: ..`, without their numbers; what comes before the first is left out."""
    parts = F.split(text, r"(?:## *)?Step [0-9]+[:.]")
    return F.filter(F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1))), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def fenced(text: Column) -> Column:
    """The content of the first triple-backtick block, without a language name."""
    return matched(text, r"(?s)```(?:\w+\n)?(.*?)```")


def json_score(text: Column, top: float = 10.0) -> Column:
    """score of the {...} block, as a share of the highest."""
    return F.get_json_object(F.regexp_extract(text, r"(?s)(\{.*\})", 1), "$.score").cast("double") / top


def sub_questions(text: Column) -> Column:
    """Numbered questions; without any, the quoted parts that end in a question mark."""
    numbered = F.regexp_extract_all(text, F.lit(r"\d+\.\s*(.*?\?)"), F.lit(1))
    return F.when(F.size(numbered) > 0, numbered).otherwise(F.filter(F.split(text, '"'), lambda s: s.endswith("?")))


def prompts_between(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?s)<START>(.*?)<END>"), F.lit(1))


def without_computations(text: Column) -> Column:
    return F.regexp_replace(text, "<<.*?>>", "")


def normalised(text: Column) -> Column:
    """Lower case, without punctuation and articles, spaces squeezed."""
    t = F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~]", "")
    return F.array_join(F.filter(F.split(t, r"\s+"), lambda w: ~w.isin("", "a", "an", "the")), " ")


def spelled_number(text: Column) -> Column:
    """A number in digits: commas dropped, a percent sign taken as hundredths."""
    t = F.translate(F.trim(text), ",", "")
    return F.coalesce(t.try_cast("double"), F.when(t.endswith("%"), F.rtrim(t, F.lit("%")).try_cast("double") / 100))


def outcome(message: Column, steps: Column, max_steps: int) -> Column:
    """Label of how a session ended, from its last message and length."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return (
        F.when(m.contains("repeat"), "action repeat")
        .when(m.contains("error"), "action error")
        .when(steps >= max_steps, "max steps reached")
        .when(m == "", "no response")
        .otherwise("response returned")
    )


FORMS: dict[str, Callable[[Column], Column]] = {
    "final_number": final_number, "gold_answer": gold_answer, "marked_number": marked_number, "choice_letter": choice_letter, "choice_tag": choice_tag, "last_choice": last_choice,
    "yes_no": yes_no, "parsed_answer": parsed_answer, "labelled_answer": labelled_answer, "last_number": last_number, "boxed": boxed,
}
