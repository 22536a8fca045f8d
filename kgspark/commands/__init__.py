"""Commands. Each module of this package that has a Command with a name is one."""

from __future__ import annotations

import argparse
import importlib
import pkgutil


class Command:
    name = ""
    help = ""

    def arguments(self, parser: argparse.ArgumentParser) -> None:
        raise NotImplementedError

    def run(self, args: argparse.Namespace) -> int:
        raise NotImplementedError


def discovered() -> dict[str, Command]:
    for m in pkgutil.iter_modules(__path__):
        importlib.import_module(f"{__name__}.{m.name}")
    todo, found = list(Command.__subclasses__()), {}
    while todo:
        c = todo.pop()
        todo += c.__subclasses__()
        if c.name:
            found[c.name] = c()
    return found


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="kgspark", description="Knowledge graphs from mappings, on Spark")
    below = parser.add_subparsers(dest="command", required=True)
    commands = discovered()
    for name, command in sorted(commands.items()):
        command.arguments(below.add_parser(name, help=command.help))
    args = parser.parse_args(argv)
    return commands[args.command].run(args)
