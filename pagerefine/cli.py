"""Command line: fetch, list, promote, delete, config, links, fetch-links, mcp, help."""

from __future__ import annotations

import json
import logging
import sys
from dataclasses import dataclass, field

from pagerefine.config import WAIT, Config, load
from pagerefine.service import Service

COMMANDS = ("fetch", "list", "promote", "delete", "config", "links", "fetch-links", "mcp", "help")
FORMATS = ("text", "json", "path", "summary")
HELP = """pagerefine <command> [options]

  fetch <url>        fetch a page, clean it and keep it (-q, -o text|json|path|summary, --pretty, --refetch, -v,
                     --min-quality N, --temp-dir D, --docs-dir D, --wait-strategy S, --force-rendered,
                     --renderer module:function, without which or such a setting no page can be rendered)
  list               list what is kept
  promote <ref>      move a reference to the documents
  delete <ref>       delete a reference
  links <ref>        list a reference's links
  fetch-links <ref>  fetch all of them
  config             show the settings
  mcp                serve tools over standard input and output
  help               this text"""


@dataclass
class Options:
    command: str
    argument: str | None = None
    values: dict = field(default_factory=dict)
    flags: set = field(default_factory=set)


def parse_args(argv: list[str]) -> Options:
    """Unknown options and invalid choices are ignored; -h after a command, no command and an unknown one mean help."""
    if not argv or argv[0] not in COMMANDS or "-h" in argv[1:] or "--help" in argv[1:]:
        return Options("help")
    out, rest = Options(argv[0]), iter(argv[1:])
    takes = {"-q": "query", "--query": "query", "-o": "output", "--output": "output", "--min-quality": "min_quality", "--temp-dir": "temp_dir", "--docs-dir": "docs_dir", "--wait-strategy": "wait_strategy", "--renderer": "renderer"}
    flags = {"--pretty": "pretty", "--refetch": "refetch", "-v": "verbose", "--verbose": "verbose", "--force-rendered": "force", "--force-playwright": "force"}
    for word in rest:
        if word in takes:
            name, value = takes[word], next(rest, None)
            valid = {"output": value in FORMATS, "wait_strategy": value in WAIT, "min_quality": bool(value) and value.lstrip("+-").isdigit()}.get(name, value is not None)
            if valid:
                out.values[name] = int(value) if name == "min_quality" else value
        elif word in flags:
            out.flags.add(flags[word])
        elif not word.startswith("-") and out.argument is None:
            out.argument = word
    return out


def as_json(found: dict) -> str:
    """A result without its ready-made texts; of links that couldn't be listed only the error."""
    left_out = {"text", "pretty", "tool"} | ({"count", "links"} if not found["success"] else set()) | ({"sourceRef"} if "message" in found else set())
    return json.dumps({k: v for k, v in found.items() if k not in left_out}, indent=2, ensure_ascii=False)


def failed_text(found: dict) -> str:
    lines = [found.get("text") or f"Error: {found['error']}"]
    lines += [f"Suggestion: {found['suggestion']}"] if found.get("suggestion") else []
    lines += [f"Quality: {found['quality']['score']}/100"] if found.get("quality") else []
    return "\n".join(lines)


def _show(found: dict, output: str, pretty: bool, text) -> int:
    if output == "json":
        print(as_json(found))
    elif not found["success"]:
        print(failed_text(found), file=sys.stderr)
    else:
        print(text(found, pretty))
    return 0 if found["success"] else 1


def _fetched(output: str):
    def text(r: dict, pretty: bool) -> str:
        if output == "path":
            return r["filepath"]
        if output == "summary" and not r.get("alreadyExists"):
            return f"{r['refId']}|{r['filepath']}"
        return r["pretty"] if pretty and "pretty" in r else r["text"]

    return text


def links_text(r: dict, pretty: bool = False) -> str:
    mark = "🔗 " if pretty else ""
    if not r["count"]:
        return f"{mark}No links found in {r['sourceRef']}"
    line = (lambda x: f"  {x['text']}\n    → {x['href']}") if pretty else (lambda x: f"{x['text']} | {x['href']}")
    hints = [f"\n💡 To fetch all: pagerefine fetch-links {r['sourceRef']}"] if pretty else []
    return "\n".join([f"{mark}Found {r['count']} links in {r['sourceRef']}:\n", *map(line, r["links"]), *hints])


def promoted_text(ref_id: str, r: dict, pretty: bool = False) -> str:
    if pretty:
        return f"✅ Promoted {ref_id}\n   From: {r['fromPath']}\n   To:   {r['toPath']}"
    return f"Promoted: {ref_id}\nFrom: {r['fromPath']}\nTo: {r['toPath']}"


def deleted_text(ref_id: str, r: dict, pretty: bool = False) -> str:
    return f"✅ Deleted {ref_id}\n   File: {r['filepath']}" if pretty else f"Deleted: {ref_id}\nFile: {r['filepath']}"


def crawl_text(r: dict, pretty: bool = False, frame: bool = True) -> str:
    mark = "🔗 " if pretty else ""
    if not r["results"]:
        return f"{mark}No links found in {r['sourceRef']}"
    lines = [f"{mark}Fetching {len(r['results'])} links from {r['sourceRef']}...\n"] if frame else []
    for x in r["results"]:
        if pretty:
            lines.append({"new": f"✓ {x.get('refId')} (new)", "cached": f"○ {x.get('refId')} (already cached)"}.get(x["status"], f"✗ {x['url'][:50]}... ({x.get('error')})"))
        else:
            lines.append(f"{x['status']}: {x['refId']}" if x["status"] != "failed" else f"failed: {x['url']} - {x.get('error')}")
    s = r["summary"]
    return "\n".join([*lines, "", f"{'📊 ' if pretty else ''}Summary: {s['new']} new, {s['cached']} cached, {s['failed']} failed"])


def list_text(refs: list[dict], folder: str, pretty: bool = False) -> str:
    if not refs:
        return f"No cached references in {folder}/"
    clip = lambda t, n: t[:n] + ("..." if len(t) > n else "")
    out = [f"{'📚 ' if pretty else ''}Cached references ({len(refs)}):\n"]
    for r in refs:
        kb = (r["size"] + 512) // 1024
        middle = f"   📅 {r['fetchedDate']} | 📄 {kb}KB\n   🔗 {clip(r['url'], 60)}" if pretty else f"  Date: {r['fetchedDate']} | Size: {kb}KB\n  URL: {clip(r['url'], 60)}"
        out.append(f"{r['refId']} | {clip(r['title'], 50)}\n{middle}\n")
    hints = ["💡 To promote: pagerefine promote <ref-id>", "💡 To delete: pagerefine delete <ref-id>"] if pretty else []
    return "\n".join([*out, *hints])


def run(argv: list[str], make_service=None) -> int:
    """Exit status: 1 on an error, else 0. make_service(config) gives the Service; by default one that fetches over HTTP."""
    o = parse_args(argv)
    if o.command == "help":
        print(HELP)
        return 0
    own = o.values if o.command == "fetch" else {}
    config: Config = load(**{k: own.get(k) for k in ("min_quality", "temp_dir", "docs_dir", "wait_strategy", "renderer")})
    if o.command == "config":
        print("Current configuration:\n")
        print(json.dumps(config.as_dict(), indent=2))
        return 0
    make = make_service or _default_service
    if o.command == "mcp":
        from pagerefine.server import serve

        serve(make)
        return 0
    if o.command != "list" and o.argument is None:
        print(f"Error: {o.command} needs an argument", file=sys.stderr)
        return 1
    service: Service = make(config)
    output, pretty = o.values.get("output", "text"), "pretty" in o.flags
    if "verbose" in o.flags:
        logging.basicConfig(stream=sys.stderr, format="%(message)s")
        logging.getLogger("pagerefine").setLevel(logging.DEBUG)
        logging.getLogger("pagerefine").debug("settings: %s", json.dumps(config.as_dict()))
    if o.command == "list":
        refs = service.list_cached()
        print(json.dumps(refs, indent=2, ensure_ascii=False) if output == "json" else list_text(refs, config.paths.temp_dir, pretty))
        return 0
    if o.command == "fetch":
        found = service.fetch_url(o.argument, o.values.get("query"), "refetch" in o.flags, "force" in o.flags)
        return _show(found, output, pretty, _fetched(output))
    if o.command == "promote":
        return _show(service.promote_reference(o.argument), output, pretty, lambda r, pretty: promoted_text(o.argument, r, pretty))
    if o.command == "delete":
        return _show(service.delete_cached(o.argument), output, pretty, lambda r, pretty: deleted_text(o.argument, r, pretty))
    if o.command == "links":
        return _show(service.extract_links(o.argument), output, pretty, links_text)
    return _show(service.fetch_links(o.argument, "refetch" in o.flags), output, pretty, crawl_text)


def _default_service(config: Config) -> Service:
    from pyspark.sql import SparkSession

    from pagerefine.service import live

    spark = SparkSession.builder.appName("pagerefine").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return Service(spark, config, live(spark))


def main() -> None:
    sys.exit(run(sys.argv[1:]))


if __name__ == "__main__":
    main()
