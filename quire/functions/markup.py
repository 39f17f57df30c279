"""Column functions that write markup: article HTML, links at mentions of subjects, answers of a model as values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions.answers import candidates
from quire.functions.text import is_yes, once

#: Characters that mark blocks while text is put together; a text's own are dropped.
BLOCK, OPEN, CLOSE, BREAK = "\x01", "\x02", "\x03", "\x04"
#: A table row that only rules off the head (three cells), or is empty: it shows nothing and does not end its table.
RULE = r"\|(?: *:? *(?:- *){3,}:? *\|){3}|\|\|?"
#: What links are not put into: links, code, anchors.
PROTECTED = r"(\[[^\]]*\]\([^)]+\)|`[^`]+`|(?s:<a\b[^>]*>.*?</a>))"


def escaped(text: Column) -> Column:
    """Text with the characters that HTML reserves as entities."""
    for mark, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        text = F.replace(text, F.lit(mark), F.lit(entity))
    return text


def inline_html(text: Column) -> Column:
    """One block's text as HTML: links, bold and italic; everything else is escaped."""
    linked = F.regexp_replace(escaped(text), r"\[([^\]]+)\]\(([^)]+)\)", '<a href="$2">$1</a>')
    bold = F.regexp_replace(linked, r"\*\*(.+?)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(bold, r"(?<!\*)\*(?!\*)(.+?)(?<!\*)\*(?!\*)", "<em>$1</em>")


def _row(line: Column, tag: str) -> Column:
    cells = F.transform(F.split(F.substr(line, F.lit(2), F.length(line) - 2), r"\|"), lambda c: F.concat(F.lit(f"<{tag}>"), inline_html(F.trim(c)), F.lit(f"</{tag}>")))
    return F.concat(F.lit("<tr>"), F.array_join(cells, ""), F.lit("</tr>"))


def article_html(markdown: Column) -> Column:
    """An article's body as HTML: second-level headings, lists, tables and paragraphs, one block a line; top headings are left out.

    Each line is told by itself and by the one before, so the work grows with the text; lines that follow each other join in one
    paragraph, list or table. Null stays null, blank texts become empty.
    """
    bare = F.regexp_replace(F.regexp_replace(markdown, f"[{BLOCK}-{BREAK}]", ""), r"\r\n|\r", "\n")
    bare = F.regexp_replace(F.regexp_replace(bare, r"(?m)^[ \t]+|[ \t]+$", ""), rf"(?m)^(\|.+\|)$(?:\n(?:{RULE})$)+", "$1")
    lines = F.split(F.regexp_replace(bare, rf"(?m)^(?:{RULE})$", ""), "\n")
    kind = lambda x: F.when(x.rlike(r"^\|.+\|$"), "t").when(x.startswith("## "), "h").when((x == "") | x.startswith("# "), "").when(x.startswith("- "), "l").otherwise("p")
    told = F.transform(lines, lambda x: F.struct(x.alias("x"), kind(x).alias("k")))

    def part(line: Column, i: Column) -> Column:
        before, text, k = F.when(i > 0, F.get(told, i - 1)["k"]).otherwise(""), line["x"], line["k"]
        return F.when(k == "p", F.concat(F.when(before == "p", " ").otherwise(BLOCK + "p"), text)).when(k == "t", F.concat(F.when(before == "t", BLOCK + "t").otherwise(BLOCK + "T"), text)).otherwise(F.concat(F.lit(BLOCK), k, text))

    def shown(block: Column) -> Column:
        k, text = F.substring(block, 1, 1), F.substr(block, F.lit(2))
        return (
            F.when(k == "p", F.concat(F.lit("<p>"), inline_html(text), F.lit("</p>")))
            .when(k == "h", F.concat(F.lit("<h2>"), escaped(F.trim(F.substr(text, F.lit(4)))), F.lit("</h2>")))
            .when(k == "l", F.concat(F.lit(f"{OPEN}<ul>"), F.lit("<li>"), inline_html(F.trim(F.substr(text, F.lit(3)))), F.lit(f"</li></ul>{CLOSE}")))
            .when(k == "T", F.concat(F.lit("<table>\n"), _row(text, "th"), F.lit(f"\n</table>{CLOSE}")))
            .when(k == "t", F.concat(F.lit(f"{OPEN}<table>\n"), _row(text, "td"), F.lit("\n</table>")))
            .otherwise(F.lit(BREAK))
        )

    blocks = F.slice(F.split(F.array_join(F.transform(told, part), ""), BLOCK), 2, 1_000_000_000)
    blocks = F.transform(blocks, lambda b: F.when(F.length(b) > 0, shown(b)).otherwise(F.lit(BREAK)))
    html = F.array_join(blocks, "\n")
    html = F.replace(html, F.lit(f"</ul>{CLOSE}\n{OPEN}<ul>"), F.lit(""))
    html = F.regexp_replace(html, f"\n</table>{CLOSE}?\n{OPEN}<table>", "")
    html = F.regexp_replace(html, f"[{OPEN}{CLOSE}]", "")
    return F.regexp_replace(F.regexp_replace(html, f"(?:^|\n){BREAK}", ""), "^\n", "")


def _mention(label: Column) -> Column:
    words = F.regexp_replace(F.replace(F.regexp_replace(label, r"^\s+|\s+$", ""), F.lit("\\E"), F.lit("")), r"\s+", r"\\E\\s+\\Q")
    return F.concat(F.lit(f"(?iu)(?U){PROTECTED}|(?<!\\w)(\\Q"), words, F.lit("\\E)(?!\\w)"))


def linked_mentions(text: Column, subjects: Column) -> Column:
    """struct(text, unresolved): every whole-word mention of a subject links to it, and the labels that are not mentioned.

    subjects: array<struct<label, href>>. Longer labels go first, ties by label; case and the width of spaces don't matter; links,
    code and anchors, those just written among them, stay as they are. Blank labels are unresolved. Null text stays null.
    """
    named = F.filter(F.coalesce(subjects, F.array().cast("array<struct<label:string,href:string>>")), lambda s: s["label"].isNotNull())
    ordered = F.array_sort(F.transform(named, lambda s: F.struct((-F.length(s["label"])).alias("n"), s["label"].alias("label"), s["href"].alias("href"))))
    begin = F.struct(F.regexp_replace(text, f"[{OPEN}{CLOSE}]", "").alias("text"), F.array().cast("array<string>").alias("unresolved"))

    def step(state: Column, s: Column) -> Column:
        marked = F.replace(F.regexp_replace(state["text"], _mention(s["label"]), F.lit(f"$1{OPEN}$2{CLOSE}")), F.lit(OPEN + CLOSE), F.lit(""))
        linked = F.replace(F.replace(marked, F.lit(OPEN), F.lit("[")), F.lit(CLOSE), F.concat(F.lit("]("), s["href"], F.lit(")")))
        found = marked.contains(OPEN) & (F.trim(s["label"]) != "")
        return F.struct(F.when(found, linked).otherwise(state["text"]).alias("text"), F.when(found, state["unresolved"]).otherwise(F.array_append(state["unresolved"], s["label"])).alias("unresolved"))

    return F.aggregate(ordered, begin, step)


def same_answer(content: Column) -> Column:
    """struct(same, reason) of the first JSON object with "same" in an answer: the whole, what its fence holds, or objects in its prose; else null.

    Objects in prose may hold objects, however deep.
    """
    read = F.transform(candidates(content, "same"), lambda c: F.from_json(c, "same string, reason string"))
    first = F.get(F.filter(read, lambda r: r["same"].isNotNull()), F.lit(0))
    return once(first, lambda r: F.when(r.isNotNull(), F.struct(is_yes(r["same"]).alias("same"), F.coalesce(F.trim(r["reason"]), F.lit("")).alias("reason"))))
