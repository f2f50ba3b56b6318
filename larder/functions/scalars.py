"""Scalar functions over columns: times, names, keys and texts."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NAMES = ("Mon", "Tue", "Wed", "Thu", "Fri", "Sat", "Sun")
SEPARATOR = "||"

# Keywords of product names per category, in order of precedence.
PRODUCT_KEYWORDS = {
    "japanese": ["sushi", "maki", "nigiri", "teriyaki", "ramen", "udon", "tempura", "sashimi", "sake", "edamame", "gyoza", "yakitori"],
    "italian": ["pizza", "pasta", "risotto", "lasagna", "bolognese", "carbonara", "margherita", "calzone", "penne", "spaghetti"],
    "thai": ["pad thai", "curry", "green curry", "red curry", "satay", "tom yum", "tom kha", "panang", "massaman"],
    "indian": ["biryani", "tikka", "korma", "tandoori", "naan", "masala", "vindaloo", "samosa", "pakora", "dal", "paneer"],
    "chinese": ["wok", "szechuan", "dim sum", "chow mein", "kung pao", "sweet and sour", "spring roll", "fried rice"],
    "mexican": ["taco", "burrito", "quesadilla", "nachos", "enchilada", "fajita", "guacamole", "salsa"],
    "greek": ["souvlaki", "gyros", "tzatziki", "moussaka", "feta"],
    "burger": ["burger", "hamburgare", "cheeseburger"],
    "kebab": ["kebab", "döner", "falafel", "hummus", "shawarma"],
    "swedish": ["köttbullar", "gravlax", "räkmacka", "tunnbröd"],
}
# Sizes and quantities that do not belong to a product's name.
SIZE_PATTERNS = (r"\b(small|medium|large|xl|xxl)\b", r"\b(liten|mellan|stor)\b", r"\d+\s*(ml|cl|l|g|kg)\b", r"\d+\s*st\b")


def hour_of(time: Column) -> Column:
    """Hour of ``HH:MM:SS``; null if it isn't a number."""
    return F.get(F.split(time, ":"), F.lit(0)).try_cast("int")


def day_name(day_of_week: Column) -> Column:
    """Mon..Sun for 0..6, else ``Unknown``."""
    names = F.array(*[F.lit(x) for x in DAY_NAMES])
    return F.when(day_of_week.between(0, 6), F.get(names, day_of_week)).otherwise("Unknown")


def meal_of(hour: Column) -> Column:
    return F.when(hour.between(6, 10), "breakfast").when(hour.between(11, 14), "lunch").when(hour.between(15, 17), "afternoon").when(hour.between(18, 21), "dinner").otherwise("late_night")


def item_of(target: str, vendor: str = "vendor_id", cuisine: str = "cuisine", product: str = "product_id") -> Column:
    """The item that a prediction target names; an unknown target means the cuisine."""
    if target == "vendor":
        return F.col(vendor)
    if target == "product":
        return F.col(product)
    if target == "vendor_cuisine":
        return F.concat_ws(SEPARATOR, F.col(vendor), F.col(cuisine))
    return F.col(cuisine)


def item_vendor(item: Column) -> Column:
    """What stands before the first separator; ``unknown`` without one."""
    return F.when(item.contains(SEPARATOR), F.substring_index(item, SEPARATOR, 1)).otherwise("unknown")


def item_cuisine(item: Column) -> Column:
    """What stands after the first separator; all of it without one."""
    return F.when(item.contains(SEPARATOR), F.substring(item, F.instr(item, SEPARATOR) + 2, F.length(item))).otherwise(item)


def product_words(name: Column) -> Column:
    """Lower case without sizes and quantities, blanks collapsed."""
    out = F.lower(F.coalesce(name, F.lit("")))
    for p in SIZE_PATTERNS:
        out = F.regexp_replace(out, p, "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def product_category(words: Column) -> Column:
    """The first category any of whose keywords the words hold, else null."""
    out = F.lit(None).cast("string")
    for name, keys in reversed(PRODUCT_KEYWORDS.items()):
        hit = F.lit(False)
        for k in keys:
            hit = hit | words.contains(k)
        out = F.when(hit, name).otherwise(out)
    return out


def category_confidence(words: Column, name: str) -> Column:
    """Half a point per keyword found, at most 1."""
    hits = sum((words.contains(k).cast("int") for k in PRODUCT_KEYWORDS[name]), F.lit(0))
    return F.least(F.lit(1.0), hits * 0.5)


def yes_no(response: Column) -> Column:
    """Yes, No or Unknown: by prefix of the answer, else by the one word of the two that occurs."""
    t = F.lower(F.trim(F.regexp_replace(F.element_at(F.split(F.coalesce(response, F.lit("")), "assistant"), -1), r"(?s)<think>.*?</think>", "")))
    t = F.regexp_replace(t, r"^\s+|\s+$", "")
    yes, no = t.contains("yes"), t.contains("no")
    return F.when(t.startswith("yes"), "Yes").when(t.startswith("no"), "No").when(yes & ~no, "Yes").when(no & ~yes, "No").otherwise("Unknown")


def embedded_list(text: Column, field: str) -> Column:
    """The list of strings under ``field`` of the first flat JSON object that has it; null if there is none."""
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r'(\{[^{}]*"' + field + r'"[^{}]*\})', 1)
    return F.from_json(F.nullif(found, F.lit("")), f"{field} array<string>")[field]


def fenced(text: Column) -> Column:
    """What stands in the first code fence, or the whole text."""
    inner = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)(?:```|$)", 1)
    return F.trim(F.when(text.contains("```"), inner).otherwise(text))


def predictions(text: Column) -> Column:
    """``predictions`` of a fenced or plain JSON text: (cuisine, confidence), lower case and trimmed, 0.5 by default, blanks dropped."""
    parsed = F.from_json(fenced(text), "predictions array<struct<cuisine:string,confidence:double>>")["predictions"]
    tidy = F.transform(parsed, lambda p: F.struct(F.trim(F.lower(p["cuisine"])).alias("cuisine"), F.coalesce(p["confidence"], F.lit(0.5)).alias("confidence")))
    return F.filter(tidy, lambda p: F.coalesce(p["cuisine"] != "", F.lit(False)))


def word_count(text: Column) -> Column:
    t = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " ")))


def without_ansi(text: Column) -> Column:
    return F.regexp_replace(text, "\x1b\\[[0-9;]*[A-Za-z]", "")


def chat_messages(system: Column, instruction: Column, given: Column, history: Column | None = None) -> Column:
    """Chat messages up to the user's: system and turns of ``history`` (role, content) where they hold anything, then the
    instruction with what is given, a blank line between them. Nulls and empty texts count as absent."""
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    said = lambda c: F.coalesce(c, F.lit(""))
    user = F.when(said(given) == "", said(instruction)).otherwise(F.concat(said(instruction), F.lit("\n\n"), given))
    first = F.filter(F.array(turn("system", said(system))), lambda x: x["content"] != "")
    if history is None:
        return F.concat(first, F.array(turn("user", user)))
    told = F.filter(F.transform(F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), lambda x: F.struct(said(x["role"]).alias("role"), said(x["content"]).alias("content"))), lambda x: (x["role"] != "") & (x["content"] != ""))
    return F.concat(first, told, F.array(turn("user", user)))


def filled_template(template: str, values: dict[str, Column], required: tuple[str, ...] = ()) -> Column:
    """A template with its ``{names}`` replaced by columns as text (null as an empty one); doubled braces are braces.

    A required name without a column, or a name of the template without one, is an error before anything runs.
    """
    missing = [v for v in required if v not in values]
    if missing:
        raise ValueError(f"missing required variables: {missing}")
    parts = []
    for said, name, _, _ in Formatter().parse(template):
        if said:
            parts.append(F.lit(said))
        if name is not None:
            if name not in values:
                raise ValueError(f"no value for template variable: {name}")
            parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
    return F.concat(*parts) if parts else F.lit("")


def slug(name: Column) -> Column:
    """Runs of other signs than letters and digits as one underscore; ``agent`` if nothing is left."""
    s = F.regexp_replace(F.regexp_replace(name, r"[^0-9A-Za-z]+", "_"), r"^_+|_+$", "")
    return F.when(s == "", "agent").otherwise(s)


def rank_of(items: Column, target: Column) -> Column:
    """1-based position ignoring case, 0 if absent or null."""
    return F.coalesce(F.array_position(F.transform(items, lambda x: F.lower(x)), F.lower(target)), F.lit(0)).cast("int")


def last_of(items: Column, n: int) -> Column:
    """The last ``n`` elements, all if there are fewer."""
    return F.slice(items, F.greatest(F.size(items) - n + 1, F.lit(1)), n)


def ndcg_of(rank: Column, k: int) -> Column:
    return F.when(rank.between(1, k), 1 / F.log2(rank + 1.0)).otherwise(0.0)


def hit_of(rank: Column, k: int) -> Column:
    return F.when(rank.between(1, k), 1.0).otherwise(0.0)
