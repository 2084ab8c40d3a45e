"""Scalar functions on names, addresses, prompts, answers and personal data, as Column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The file types with a reader.
READERS = {"pdf": "pdf", "url": "link", "txt": "text", "md": "text", "doc": "text", "docx": "text", "rtf": "text", "html": "text", "jpg": "image", "jpeg": "image", "png": "image"}


def extension(name: Column) -> Column:
    """Lower-cased letters after the last dot of the last path segment; what follows an ``&action`` is left out."""
    plain = F.regexp_replace(F.substring_index(name, "/", -1), "&action.*$", "")
    return F.lower(F.regexp_extract(plain, r"\.([^.]*)$", 1))


def reader(name: Column) -> Column:
    found = F.create_map(*[F.lit(x) for pair in READERS.items() for x in pair])
    return F.try_element_at(found, extension(name))


def title(url: Column) -> Column:
    """The last path segment, or what an office address names between ``file=`` and ``&action``."""
    named = F.regexp_extract(url, "file=(.*?)&action", 1)
    return F.when(named != "", named).otherwise(F.substring_index(url, "/", -1))


def rebase(url: Column, folder: Column) -> Column:
    return F.concat(folder, F.lit("/"), F.substring_index(url, "/", -1))


def first_url(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"https?://[^\s]+", 0), F.lit(""))


#: The elements whose content is no text.
HIDDEN = ("script", "style", "head", "nav", "footer", "iframe", "noscript")
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def main_text(html: Column) -> Column:
    """Visible text of a page in printable ASCII, white space as one space."""
    steps = [r"(?s)<!--.*?-->", *[rf"(?is)<{t}\b[^>]*>.*?</{t}>" for t in HIDDEN], r"(?s)<[^>]*>"]
    bare = reduce(lambda c, p: F.regexp_replace(c, p, " "), steps, html)
    named = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), _ENTITIES, F.regexp_replace(bare, "&(copy|middot);", ""))
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(named, r"\s+", " "), "[^\\x20-\\x7E]", ""), " +", " "))


def clean_base64(data: Column) -> Column:
    """What follows the data address's comma, padded to a multiple of four; null without a comma."""
    body = F.substring_index(data, ",", -1)
    padded = F.concat(body, F.repeat(F.lit("="), (4 - F.length(body) % 4) % 4))
    return F.when(F.contains(data, F.lit(",")), padded)


def valid_base64_image(data: Column) -> Column:
    body = F.regexp_replace(data, "^data:image/[a-z]+;base64,", "")
    return body.rlike("^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) >= 100)


def data_mime(address: Column) -> Column:
    return F.nullif(F.regexp_extract(address, "^data:([^;,]+)", 1), F.lit(""))


def acceptable_image(mime: Column, data: Column, most_bytes: int = 20 * 1024 * 1024) -> Column:
    size = F.length(F.try_to_binary(data, F.lit("base64")))
    return F.when(~mime.isin("image/png", "image/jpeg"), "type").when(size.isNull(), "content").when(size > most_bytes, "size").otherwise("ok")


def thought(answer: Column) -> Column:
    """What stands in the first think tag; an opening tag that is missing is taken to be at the start."""
    whole = F.when(F.contains(answer, F.lit("</think>")) & ~F.contains(answer, F.lit("<think>")), F.concat(F.lit("<think>"), answer)).otherwise(answer)
    return F.trim(F.regexp_extract(whole, "(?s)<think>(.*?)</think>", 1))


def without_thought(answer: Column) -> Column:
    whole = F.when(F.contains(answer, F.lit("</think>")) & ~F.contains(answer, F.lit("<think>")), F.concat(F.lit("<think>"), answer)).otherwise(answer)
    return F.trim(F.regexp_replace(whole, "(?s)<think>.*?</think>", ""))


#: What stands around JSON in an answer.
FENCE = "```json|```"


def fenced_json(answer: Column) -> Column:
    return F.trim(F.regexp_replace(answer, FENCE, ""))


def unfenced(answer: str) -> str:
    """``fenced_json`` of one answer."""
    return re.sub(FENCE, "", answer).strip(" ")


def strip_label(answer: Column, label: str) -> Column:
    """The answer without a leading label, colon and spaces."""
    return F.regexp_replace(F.regexp_replace(answer, f"^{label}", ""), "^[: ]+", "")


#: What stands for an image in a prompt, by its title, and what announces the user's own.
KNOWLEDGE_IMAGE = ("[KNOWLEDGE BASE IMAGE: ", "] - This is an image from the knowledge base that has been attached to this message. Please analyze this image as reference material for answering the question.")
USER_IMAGE = "USER PROVIDED IMAGE: The user has provided an image for analysis. Please analyze this image and reference it in your response when relevant to the question. The image is attached to this message."


def context_content(content: Column, title: Column) -> Column:
    """A chunk's content as a prompt holds it: an image's data address becomes a placeholder."""
    image = F.startswith(content, F.lit("data:image/")) & F.contains(content, F.lit("base64,"))
    return F.when(image, F.concat(F.lit(KNOWLEDGE_IMAGE[0]), F.coalesce(title, F.lit("Unknown")), F.lit(KNOWLEDGE_IMAGE[1]))).otherwise(content)


def context_chunk(title: Column, url: Column, start_page: Column, end_page: Column, content: Column) -> Column:
    """A chunk in the prompt's markup, whose tags are a fixed format."""
    parts = (("title", F.coalesce(title, F.lit("Unknown"))), ("url", F.coalesce(url, F.lit(""))), ("startPage", start_page), ("endPage", end_page), ("content", content))
    tagged = [x for tag, value in parts for x in (F.lit(f"<{tag}>"), F.coalesce(value.cast("string"), F.lit("")), F.lit(f"</{tag}>"))]
    return F.concat(F.lit("<ContextChunk>"), *tagged, F.lit("</ContextChunk>"))


def few_shot_example(fields: dict[str, Column], tagged: bool = False) -> Column:
    """An example of a prompt, a line for each field: under a heading or, for models that read tags better, in a tag."""
    lines = F.concat_ws("\n", *[F.concat(F.lit(f"{name}: "), value) for name, value in fields.items()])
    return F.concat(F.lit("<Example>\n"), lines, F.lit("\n</Example>")) if tagged else F.concat(F.lit("## Example\n"), lines)


# ---------------------------------------------------------------- messages

MESSAGE = "struct<role:string,parts:array<struct<kind:string,text:string,data:string,reasoning:string,file:struct<name:string,mime_type:string,bytes:string>>>,message_id:string>"
#: Roles and kinds of parts.
ROLES, KINDS = ("user", "assistant", "system"), ("text", "data", "reasoning", "file")


def normalised(message: Column) -> Column:
    """A message of JSON as a struct: role, parts and message_id; null if the JSON, the role or a part's kind is none."""
    parsed = F.from_json(message, MESSAGE)
    known = parsed["role"].isin(*ROLES) & F.forall(parsed["parts"], lambda p: F.coalesce(p["kind"].isin(*KINDS), F.lit(False)))
    return F.when(known, parsed)


def first_part(message: Column, kind: str) -> Column:
    """The text, data (as JSON) or reasoning of a normalised message's first part of that kind; null if it has none."""
    return F.try_element_at(F.filter(message["parts"], lambda p: p["kind"] == kind), F.lit(1))[kind]


def content_parts(message: Column) -> Column:
    """A normalised message's parts as a chat model takes them: structs of type and value. Images go as data addresses, other files by their bytes,
    data and reasoning fail the query, as there is no such content."""

    def part(p: Column) -> Column:
        image = F.startswith(p["file"]["mime_type"], F.lit("image/"))
        address = F.concat(F.lit("data:"), p["file"]["mime_type"], F.lit(";base64,"), p["file"]["bytes"])
        kind = F.when(p["kind"] == "text", "text").when((p["kind"] == "file") & image, "image_url").when(p["kind"] == "file", "file")
        value = F.when(p["kind"] == "text", p["text"]).when(image, address).otherwise(p["file"]["bytes"])
        return F.struct(F.coalesce(kind, F.raise_error(F.concat(F.lit("no content for a part of kind "), p["kind"])).cast("string")).alias("type"), value.alias("value"))

    return F.transform(message["parts"], part)


def nullable_schema(schema: dict) -> dict:
    """A JSON schema with ``["x", "null"]`` written as a nullable x, and without ``additionalProperties: false``, at every depth."""
    out = {}
    for key, value in schema.items():
        if key == "additionalProperties" and value is False:
            continue
        if key == "type" and isinstance(value, list) and "null" in value:
            rest = [x for x in value if x != "null"]
            out |= {"type": rest[0] if len(rest) == 1 else rest, "nullable": True}
        elif isinstance(value, dict):
            out[key] = nullable_schema(value)
        else:
            out[key] = [nullable_schema(x) if isinstance(x, dict) else x for x in value] if isinstance(value, list) else value
    return out


# ---------------------------------------------------------------- personal data

#: Built-in detectors, for lack of a model: one pattern for each entity.
PII = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "phone": r"\+?[0-9]{3}[-. ][0-9]{3,4}[-. ]?[0-9]{0,4}", "ip": r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"}


#: What a text must hold for a built-in detector to find anything: texts without it are not matched.
GATES = {"email": "@", "ip": "."}


def located(text: Column, entity: str, pattern: str) -> Column:
    """Every match of a pattern: structs of entity, text and location (code points from 0), in order."""
    if PII.get(entity) == pattern and entity in GATES:
        text = F.when(text.isNull() | F.contains(text, F.lit(GATES[entity])), text).otherwise("")
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<entity:string,text:string,location:int>>").alias("found"))

    def step(s: Column, x: Column) -> Column:
        start = s["at"] + F.length(x["gap"])
        item = F.struct(F.lit(entity).alias("entity"), x["hit"].alias("text"), start.alias("location"))
        return F.struct((start + F.coalesce(F.length(x["hit"]), F.lit(0))).alias("at"), F.when(x["hit"].isNotNull(), F.concat(s["found"], F.array(item))).otherwise(s["found"]).alias("found"))

    return F.aggregate(F.arrays_zip(gaps.alias("gap"), hits.alias("hit")), state, step, lambda s: s["found"])


def item_pattern(item: str) -> str:
    """The pattern that finds an item's words whatever white space is between them; one that matches nothing for an item without words."""
    return r"\s+".join(re.escape(w) for w in item.split()) or r"(?!)"


def item_starts(text: Column, item: str) -> Column:
    """Every place (code points from 0) where an item starts, overlapping ones too."""
    found = F.split(text, f"(?={item_pattern(item)})", -1)
    upto = F.transform(F.sequence(F.lit(1), F.greatest(F.size(found) - 1, F.lit(1))), lambda k: F.aggregate(F.slice(found, 1, k), F.lit(0), lambda s, x: s + F.length(x)))
    inner = F.when(F.size(found) > 1, upto).otherwise(F.array().cast("array<int>"))
    at_start = F.when(text.rlike(f"^(?:{item_pattern(item)})"), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.concat(at_start, inner))


def category_tag(name: str) -> str:
    """What stands for a category of personal data in instructions and masked texts: upper case, spaces as hyphens."""
    return name.upper().replace(" ", "-")


def masked(text: Column, detectors: dict[str, str] = PII) -> Column:
    """The text with every detected item replaced by its entity in brackets."""
    return reduce(lambda c, d: F.regexp_replace(c, d[1], f"[{d[0].upper()}]"), detectors.items(), text)
