"""Paths without disk access, and the paths that a shell command names."""

from __future__ import annotations

import re

# They decide what counts as a path.
EXTENSIONS = (
    "rs toml lock md txt json jsonl yaml yml py js mjs cjs ts tsx jsx vue svelte html css scss sh bash zsh fish go "
    "c h cc cpp hpp java kt swift rb lua zig nix sql proto xml csv ini cfg conf env log diff patch png jpg jpeg "
    "webp gif svg pdf mp4 mov webm wav mp3"
).split()
SEPARATORS = ";|&()<>'\"`=,"
ROOTS = ("/", "./", "../", "~/")
NOT_FILES = ("/dev/", "/proc/")
MOST_FILES = 30

_TOKEN = re.compile(rf"[^\s{re.escape(SEPARATORS)}]+")
_LINE_NUMBERS = re.compile(r"(?::[0-9]+)+\Z")
_PATH = re.compile(r"(?!-)(?=.*[A-Za-z0-9])[A-Za-z0-9._/~+@-]+\Z")
_HEREDOC = re.compile(r"<<(?!<)-*\s*((?:[\w'\"])+)")


def lexical(path: str) -> str:
    """``.`` and ``..`` resolved by name alone. Above the root is the root; leading ``..`` of a relative path stay."""
    rooted, out = path.startswith("/"), []
    for part in path.split("/"):
        if part in ("", "."):
            continue
        if part != "..":
            out.append(part)
        elif out and out[-1] != "..":
            out.pop()
        elif not rooted:
            out.append("..")
    return ("/" if rooted else "") + "/".join(out)


def join(base: str, path: str) -> str:
    return path if path.startswith("/") or not base else f"{base}/{path}"


def is_path(token: str) -> bool:
    if not _PATH.match(token) or token.startswith(NOT_FILES):
        return False
    if token.startswith(ROOTS):
        return True
    parts = [p for p in token.split("/") if p not in ("", ".")]
    name = parts[-1] if parts else ""
    stem, dot, extension = name.rpartition(".")
    return bool(dot and stem) and extension.lower() in EXTENSIONS


def heredoc_word(line: str) -> str | None:
    """The word that ends a here-document opened on this line."""
    found = _HEREDOC.search(line) if line.partition("<<")[1] and not line.partition("<<")[2].startswith("<") else None
    word = re.match(r"\w*", re.sub(r"['\"]", "", found[1]))[0] if found else ""
    return word or None


def command_paths(command: str) -> list[str]:
    """Path-like tokens of a shell command, without ``cd`` targets and the bodies of here-documents."""
    out, until = [], None
    for line in command.split("\n"):
        if until is not None:
            until = None if line.strip() == until else until
            continue
        until = heredoc_word(line)
        tokens = _TOKEN.findall(line)
        for before, token in zip(["", *tokens], tokens, strict=False):
            if before != "cd":
                name = _LINE_NUMBERS.sub("", token)
                if is_path(name):
                    out.append(name)
    return out


def touched(raw: list[str], cwd: str, root: str) -> list[str]:
    """Distinct paths in order of appearance, relative to the project root where they lie in it."""
    out: list[str] = []
    for path in (r.strip() for r in raw):
        if not path or len(out) >= MOST_FILES:
            continue
        if not path.startswith("~/"):
            path = lexical(join(cwd, path))
            inside = root.rstrip("/") + "/" if root else None
            if root and path == lexical(root):
                continue
            if inside and path.startswith(inside):
                path = path[len(inside) :]
        if path not in out:
            out.append(path)
    return out
