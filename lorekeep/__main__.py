"""The command line: registered queries, and the index and graph of a data folder.

    python -m lorekeep list | QUERY [SF_DIR] [--explain]
    python -m lorekeep fetch | index | prune | status | search Q | ask Q | serve
    python -m lorekeep kg build | stats | show T | viz | chain T | path A B | compare A B
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
import urllib.parse
import urllib.request

from lorekeep import commands
from lorekeep.config import settings
from lorekeep.queries import catalogue
from lorekeep.session import session

COMMANDS = ["fetch", "index", "prune", "status", "search", "ask", "serve", "kg"]


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lorekeep")
    sub = p.add_subparsers(dest="command", required=True)
    add = lambda name, to=sub, **k: to.add_parser(name, **k)
    f = add("fetch", help="copy a wiki's pages into the raw folder")
    f.add_argument("--api", required=True, help="the wiki's api.php")
    f.add_argument("--force", action="store_true")
    f.add_argument("--ns", type=int, action="append")
    i = add("index", help="build the text index")
    i.add_argument("--text-only", action="store_true")
    i.add_argument("--embed-only", action="store_true")
    i.add_argument("--limit", type=int)
    add("prune")
    add("status")
    for name in ("search", "ask"):
        a = add(name)
        a.add_argument("question")
        a.add_argument("--top-k", "-k", type=int)
        a.add_argument("--full" if name == "search" else "--json", action="store_true")
    a.add_argument("--profile", "-p")
    a.add_argument("--decompose", action=argparse.BooleanOptionalAction, default=None)
    s = add("serve")
    s.add_argument("--host", default="127.0.0.1")
    s.add_argument("--port", type=int, default=8000)
    kg = add("kg").add_subparsers(dest="kg", required=True)
    add("build", kg).add_argument("--jsonl-only", action="store_true")
    add("stats", kg).add_argument("--top", type=int, default=12)
    for name, ends, n in (("show", ["title"], 25), ("chain", ["title"], 12), ("path", ["start", "end"], 3), ("compare", ["first", "second"], 8)):
        k = add(name, kg)
        for e in ends:
            k.add_argument(e)
        k.add_argument("--limit", "-n", type=int, default=n)
        if name in ("chain", "path"):
            k.add_argument("--hops", type=int)
        if name == "chain":
            k.add_argument("--deep-only", action="store_true")
    v = add("viz", kg)
    v.add_argument("--out", "-o")
    v.add_argument("--kind", choices=["explorer", "schema", "both"], default="both")
    return p


def run_query(args: list[str]) -> int:
    p = argparse.ArgumentParser(prog="lorekeep")
    p.add_argument("query", help="a query's name, or list")
    p.add_argument("data", nargs="?", default="/root/testdata/sf0.001", help="folder of the tables")
    p.add_argument("--rows", type=int, default=20)
    p.add_argument("--explain", action="store_true", help="show the physical plan instead")
    given = p.parse_args(args)
    if given.query == "list":
        print("\n".join(sorted(catalogue())))
        return 0
    if given.query not in catalogue():
        p.error(f"no query {given.query}; try list, or one of {', '.join(COMMANDS)}")
    df = catalogue()[given.query][0](session("local[*]"), given.data)
    df.explain("formatted") if given.explain else df.show(given.rows, truncate=80)
    return 0


def http_get(api: str):
    def get(params: dict) -> tuple[int, dict, dict]:
        url = f"{api}?{urllib.parse.urlencode(params)}"
        try:
            with urllib.request.urlopen(url, timeout=60) as r:  # noqa: S310 - the address is the user's own argument
                return r.status, dict(r.headers), json.load(r)
        except urllib.error.HTTPError as e:
            return e.code, dict(e.headers), {}

    return get


def main(args: list[str] | None = None) -> int:
    args = sys.argv[1:] if args is None else args
    if not args or args[0] not in COMMANDS:
        return run_query(args)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    given = parser().parse_args(args)
    desk = commands.Desk(session("local[*]"), settings())
    name = f"kg_{given.kg}" if given.command == "kg" else given.command
    try:
        lines = desk.fetch(http_get(given.api), given.api, given.ns, given.force) if name == "fetch" else getattr(desk, name)(given)
        for line in lines:
            print(line)
    except commands.Nothing as e:
        print(e, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
