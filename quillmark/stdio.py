"""The tools over standard input and output: one JSON-RPC 2.0 message on a line.

    python -m quillmark.stdio REGISTRY

Answers initialize, ping, tools/list and tools/call; notifications get no answer. Only answers are written to standard output.
"""

from __future__ import annotations

import argparse
import json
import sys
from typing import TextIO

from quillmark import __version__
from quillmark.functions import constants as K
from quillmark.serve import Tools

PROTOCOL = "2024-11-05"
REQUIRED = {"search_workspaces": ["query"], "get_file_content": ["file_path"], "get_workspace_info": ["workspace_id"], "get_function_content": ["file_path", "function_name"]}
ABOUT = {
    "search_workspaces": "Ranked search over all registered workspaces, or over one",
    "get_file_content": "A file of a workspace, or some of its lines, with an outline",
    "list_workspaces": "The active workspaces",
    "get_workspace_info": "A workspace's row and links, and its files on demand",
    "get_function_content": "The body of a function of a file",
}


def listed() -> list[dict]:
    return [{"name": name, "description": ABOUT[name], "inputSchema": {"type": "object", "properties": {k: {"type": t} for k, t in inputs.items()}, "required": REQUIRED.get(name, [])}} for name, inputs in K.TOOLS.items()]


def called(tools: Tools, name: str, arguments: dict) -> str:
    """The JSON text of a tool; wrong names and arguments raise."""
    calls = {"search_workspaces": tools.search_workspaces, "get_file_content": tools.file_content, "list_workspaces": tools.list_workspaces, "get_workspace_info": tools.workspace_info, "get_function_content": tools.function_content}
    if name not in calls:
        raise ValueError(f"Unknown tool: {name}")
    if (wrong := set(arguments) - set(K.TOOLS[name])) or (lacking := [x for x in REQUIRED.get(name, []) if x not in arguments]):
        raise ValueError(f"Wrong arguments of {name}: {', '.join(sorted(wrong) or lacking)}")
    return calls[name](**arguments)


def answer(tools: Tools, message: dict) -> dict | None:
    """The answer to one message; None for a notification."""
    key, method, params = message.get("id"), message.get("method"), message.get("params") or {}
    if key is None:
        return None
    out = {"jsonrpc": "2.0", "id": key}
    if method == "initialize":
        return out | {"result": {"protocolVersion": params.get("protocolVersion", PROTOCOL), "capabilities": {"tools": {}}, "serverInfo": {"name": "quillmark", "version": __version__}}}
    if method == "ping":
        return out | {"result": {}}
    if method == "tools/list":
        return out | {"result": {"tools": listed()}}
    if method == "tools/call":
        try:
            text, failed = called(tools, params.get("name", ""), params.get("arguments") or {}), False
        except Exception as error:  # a server answers on
            text, failed = json.dumps({"error": str(error)}), True
        return out | {"result": {"content": [{"type": "text", "text": text}], "isError": failed}}
    return out | {"error": {"code": -32601, "message": f"Method not found: {method}"}}


def serve(tools: Tools, lines: TextIO, out: TextIO) -> None:
    for line in lines:
        if not line.strip():
            continue
        try:
            message = json.loads(line)
            made = answer(tools, message) if isinstance(message, dict) else {"jsonrpc": "2.0", "id": None, "error": {"code": -32600, "message": "Invalid request"}}
        except ValueError:
            made = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "Parse error"}}
        if made is not None:
            out.write(json.dumps(made, ensure_ascii=False) + "\n")
            out.flush()


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="quillmark.stdio", description="Serve the tools over standard input and output.")
    parser.add_argument("registry", help="folder of the central registry")
    args = parser.parse_args(argv)
    answers, sys.stdout = sys.stdout, sys.stderr  # whatever else prints
    from pyspark.sql import SparkSession

    from quillmark.operators.registry import Registry

    serve(Tools(Registry(SparkSession.builder.appName("quillmark").config("spark.ui.showConsoleProgress", "false").getOrCreate(), args.registry)), sys.stdin, answers)
    return 0


if __name__ == "__main__":
    sys.exit(main())
