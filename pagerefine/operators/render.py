"""Results as text columns: plain lines, lines for people, JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagerefine.functions.text import clipped, size_kb, tokens


def lines(*parts: Column | str) -> Column:
    """Parts joined by line ends; null ones are left out."""
    return F.concat_ws("\n", *(x if isinstance(x, Column) else F.lit(x) for x in parts))


def labelled(label: str, value: Column) -> Column:
    """`label: value`, or null where the value is null or empty."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(label), value))


def size_line(markdown: Column) -> Column:
    return F.concat(F.length(markdown).cast("string"), F.lit(" chars (~"), tokens(markdown).cast("string"), F.lit(" tokens)"))


def saved_summary(ref_id: Column, filepath: Column) -> Column:
    return F.concat(ref_id, F.lit("|"), filepath)


#: What a result in JSON says of a page that is kept already.
ALREADY_MESSAGE = "URL already fetched. Use --refetch to update."


def already_text(ref_id: Column, filepath: Column, pretty: bool = False) -> Column:
    if pretty:
        return lines(F.concat(F.lit("📦 Already cached: "), ref_id), F.concat(F.lit("   File: "), filepath, F.lit("\n")), "💡 Use --refetch to update")
    return lines(F.concat(F.lit("Already cached: "), ref_id), F.concat(F.lit("Filepath: "), filepath), "Use --refetch to update")


def saved_text(r: dict[str, Column], pretty: bool = False, spaced: bool = False) -> Column:
    """r: ref_id, title, byline, site_name, excerpt, filepath, markdown, score, used_rendered, rendered_reason."""
    rendered = F.when(F.coalesce(r["used_rendered"], F.lit(False)), F.concat(F.lit("Yes ("), r["rendered_reason"], F.lit(")")))
    excerpt, score = clipped(r["excerpt"], 150), F.concat(r["score"].cast("string"), F.lit("/100"))
    if pretty:
        return lines(
            F.concat(F.lit("✅ Cached: "), r["ref_id"], F.lit("\n")), F.concat(F.lit("**Title**: "), r["title"]), labelled("**Author**: ", r["byline"]),
            labelled("**Source**: ", r["site_name"]), labelled("**Summary**: ", excerpt), F.concat(F.lit("\n**Saved to**: "), r["filepath"]),
            F.concat(F.lit("**Size**: "), size_line(r["markdown"])), F.concat(F.lit("**Quality**: "), score), labelled("**Playwright**: ", rendered),
            F.concat(F.lit("\n💡 To promote to docs: pagerefine promote "), r["ref_id"]),
        )
    gap = "\n" if spaced else ""
    return lines(
        F.concat(F.lit("Cached: "), r["ref_id"], F.lit(gap)), F.concat(F.lit("Title: "), r["title"]), labelled("Author: ", r["byline"]), labelled("Source: ", r["site_name"]),
        labelled("Summary: ", excerpt), F.concat(F.lit(f"{gap}Filepath: "), r["filepath"]), F.concat(F.lit("Size: "), size_line(r["markdown"])),
        F.concat(F.lit("Quality: "), score), labelled("Playwright: ", rendered),
    )


def tool_text(r: dict[str, Column]) -> Column:
    """As saved_text(), with blank lines around what was found on the page: the form in which the tool server answers."""
    return saved_text(r, spaced=True)


def tool_already_text(ref_id: Column, filepath: Column) -> Column:
    return lines(F.concat(F.lit("Already cached: "), ref_id), F.concat(F.lit("Filepath: "), filepath, F.lit("\n")), "Use refetch: true to update.")


def saved_json(r: dict[str, Column], url: Column, query: Column) -> Column:
    """r as for saved_text(): a result in JSON; what is null is left out."""
    return as_json(
        success=F.lit(True), refId=r["ref_id"], title=r["title"], byline=r["byline"], siteName=r["site_name"], excerpt=r["excerpt"], url=url, filepath=r["filepath"],
        size=F.length(r["markdown"]), tokens=tokens(r["markdown"]), quality=r["score"], usedPlaywright=r["used_rendered"], playwrightReason=r["rendered_reason"], query=query,
    )


def list_header(n: Column, folder: str, pretty: bool = False) -> Column:
    some = F.concat(F.lit("📚 Cached references (" if pretty else "Cached references ("), n.cast("string"), F.lit("):"))
    return F.when(n == 0, F.lit(f"No cached references in {folder}/")).otherwise(some)


def links_header(n: Column, ref_id: Column, pretty: bool = False, fetching: bool = False) -> Column:
    mark, said, end = ("🔗 " if pretty else ""), ("Fetching " if fetching else "Found "), ("..." if fetching else ":")
    some = F.concat(F.lit(mark + said), n.cast("string"), F.lit(" links from " if fetching else " links in "), ref_id, F.lit(end))
    return F.when(n == 0, F.concat(F.lit(f"{mark}No links found in "), ref_id)).otherwise(some)


def listed(ref_id: Column, title: Column, day: Column, size: Column, url: Column, pretty: bool = False) -> Column:
    """The three lines of a reference in a list."""
    kb = F.concat(size_kb(size).cast("string"), F.lit("KB"))
    first = F.concat(ref_id, F.lit(" | "), clipped(title, 50))
    if pretty:
        return lines(first, F.concat(F.lit("   📅 "), day, F.lit(" | 📄 "), kb), F.concat(F.lit("   🔗 "), clipped(url, 60)))
    return lines(first, F.concat(F.lit("  Date: "), day, F.lit(" | Size: "), kb), F.concat(F.lit("  URL: "), clipped(url, 60)))


def link(text: Column, href: Column, pretty: bool = False) -> Column:
    return F.concat(F.lit("  "), text, F.lit("\n    → "), href) if pretty else F.concat(text, F.lit(" | "), href)


def crawled(status: Column, ref_id: Column, url: Column, error: Column, pretty: bool = False) -> Column:
    if pretty:
        return (
            F.when(status == "new", F.concat(F.lit("✓ "), ref_id, F.lit(" (new)"))).when(status == "cached", F.concat(F.lit("○ "), ref_id, F.lit(" (already cached)")))
            .otherwise(F.concat(F.lit("✗ "), F.substring(url, 1, 50), F.lit("... ("), F.coalesce(error, F.lit("undefined")), F.lit(")")))
        )
    return (
        F.when(status == "new", F.concat(F.lit("new: "), ref_id)).when(status == "cached", F.concat(F.lit("cached: "), ref_id))
        .otherwise(F.concat(F.lit("failed: "), url, F.lit(" - "), F.coalesce(error, F.lit("undefined"))))
    )


def crawl_summary(new: Column, cached: Column, failed: Column, pretty: bool = False) -> Column:
    text = lambda c: c.cast("string")
    return F.concat(F.lit("📊 Summary: " if pretty else "Summary: "), text(new), F.lit(" new, "), text(cached), F.lit(" cached, "), text(failed), F.lit(" failed"))


def promoted(ref_id: Column, success: Column, from_path: Column, to_path: Column, error: Column, pretty: bool = False) -> Column:
    head, source, target = ("✅ Promoted ", "   From: ", "   To:   ") if pretty else ("Promoted: ", "From: ", "To: ")
    good = lines(F.concat(F.lit(head), ref_id), F.concat(F.lit(source), from_path), F.concat(F.lit(target), to_path))
    return F.when(success, good).otherwise(F.concat(F.lit("Error: "), error))


def deleted(ref_id: Column, success: Column, filepath: Column, error: Column, pretty: bool = False) -> Column:
    head, file = ("✅ Deleted ", "   File: ") if pretty else ("Deleted: ", "File: ")
    good = lines(F.concat(F.lit(head), ref_id), F.concat(F.lit(file), filepath))
    return F.when(success, good).otherwise(F.concat(F.lit("Error: "), error))


def as_json(**fields: Column) -> Column:
    """An object of the fields that aren't null."""
    return F.to_json(F.struct(*(c.alias(n) for n, c in fields.items())))
