"""Tools over standard input and output: JSON-RPC, one message a line."""

from __future__ import annotations

import json
import sys
from collections.abc import Callable

from pagerefine import __version__
from pagerefine.cli import as_json, crawl_text, deleted_text, failed_text, links_text, list_text, promoted_text
from pagerefine.config import Config, load

_TEXT, _FLAG = {"type": "string"}, {"type": "boolean"}


def _tool(name: str, description: str, needed: tuple[str, ...] = (), **properties) -> dict:
    return {"name": name, "description": description, "inputSchema": {"type": "object", "properties": properties, "required": list(needed)}}


TOOLS = [
    _tool(
        "fetch_url", "Fetch a page, clean it to Markdown and keep it", ("url",), url=_TEXT, query=_TEXT, minQuality={"type": "number"}, tempDir=_TEXT,
        outputFormat={"type": "string", "enum": ["summary", "path", "json"]}, refetch=_FLAG,
    ),
    _tool("list_cached", "List what is kept", tempDir=_TEXT),
    _tool("promote_reference", "Move a reference to the documents", ("refId",), refId=_TEXT, docsDir=_TEXT),
    _tool("delete_cached", "Delete a reference", ("refId",), refId=_TEXT),
    _tool("extract_links", "List a reference's links", ("refId",), refId=_TEXT, outputFormat={"type": "string", "enum": ["summary", "json"]}),
    _tool("fetch_links", "Fetch all links of a reference", ("refId",), refId=_TEXT, refetch=_FLAG, outputFormat={"type": "string", "enum": ["summary", "json"]}),
]


def call(name: str, args: dict, make: Callable[[Config], object]) -> str:
    """A tool's text; an unknown tool raises."""
    if name not in {t["name"] for t in TOOLS}:
        raise ValueError(f"Unknown tool: {name}")
    config = load(min_quality=args.get("minQuality"), temp_dir=args.get("tempDir"), docs_dir=args.get("docsDir"))
    service = make(config)
    wants_json = args.get("outputFormat") == "json"
    if name == "list_cached":
        return list_text(service.list_cached(), config.paths.temp_dir).strip()
    if name == "fetch_url":
        r = service.fetch_url(args["url"], args.get("query"), bool(args.get("refetch")))
    elif name == "promote_reference":
        r = service.promote_reference(args["refId"])
    elif name == "delete_cached":
        r = service.delete_cached(args["refId"])
    elif name == "extract_links":
        r = service.extract_links(args["refId"])
    else:
        r = service.fetch_links(args["refId"], bool(args.get("refetch")))
    if not r["success"]:
        return failed_text(r)
    if wants_json:
        return as_json(r | {"message": r["message"].replace("--refetch", "refetch: true")} if r.get("alreadyExists") else r)
    if name == "fetch_url":
        return r["filepath"] if args.get("outputFormat") == "path" else r["tool"]
    if name == "promote_reference":
        return promoted_text(args["refId"], r)
    if name == "delete_cached":
        return deleted_text(args["refId"], r)
    if name == "extract_links":
        return links_text(r)
    return f"Fetched links from {args['refId']}:\n\n{crawl_text(r, frame=False)}" if r["results"] else links_text(r | {"count": 0})


def answer(message: dict, make: Callable[[Config], object]) -> dict | None:
    """The reply to one message; None to a notification."""
    method, params = message.get("method"), message.get("params") or {}
    if "id" not in message:
        return None
    reply = {"jsonrpc": "2.0", "id": message["id"]}
    if method == "initialize":
        info = {"name": "pagerefine", "version": __version__}
        return reply | {"result": {"protocolVersion": params.get("protocolVersion", "2024-11-05"), "capabilities": {"tools": {}}, "serverInfo": info}}
    if method == "tools/list":
        return reply | {"result": {"tools": TOOLS}}
    if method == "tools/call":
        try:
            text = call(params.get("name", ""), params.get("arguments") or {}, make)
        except Exception as e:  # noqa: BLE001  a failed call is an error reply
            return reply | {"error": {"code": -32603, "message": str(e)}}
        return reply | {"result": {"content": [{"type": "text", "text": text}]}}
    return reply | {"error": {"code": -32601, "message": f"Unknown method: {method}"}}


def serve(make: Callable[[Config], object], lines=None, out=None) -> None:
    out = out or sys.stdout
    for line in lines or sys.stdin:
        if line.strip() and (reply := answer(json.loads(line), make)) is not None:
            print(json.dumps(reply, ensure_ascii=False), file=out, flush=True)
