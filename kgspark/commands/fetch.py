"""list-issues and list-articles: fetch JSON from public services, then run a mapping over it."""

from __future__ import annotations

import json
import logging
import os
import re
import tempfile
import urllib.parse
import urllib.request

from kgspark.commands import Command
from kgspark.commands.run import run_mapping

log = logging.getLogger(__name__)


def get_json(url: str, params: dict | None = None, timeout: int = 60):
    if params:
        url += "?" + urllib.parse.urlencode(params)
    request = urllib.request.Request(url, headers={"User-Agent": "kgspark", "Accept": "application/json"})  # noqa: S310
    with urllib.request.urlopen(request, timeout=timeout) as answer:  # noqa: S310
        return json.load(answer)


def issues_url(repository: str) -> str:
    """The address of a repository's issues; one that already is such an address stays."""
    url = urllib.parse.urlsplit(repository.rstrip("/"))
    path = url.path.strip("/").removesuffix(".git")
    if url.netloc == "github.com":
        return f"https://api.github.com/repos/{'/'.join(path.split('/')[:2])}/issues?state=all"  # closed ones, too
    if "gitlab" in url.netloc and not path.startswith("api/"):
        return f"{url.scheme}://{url.netloc}/api/v4/projects/{urllib.parse.quote(path, safe='')}/issues"
    return repository


class ListIssues(Command):
    name, help = "list-issues", "merge the issues of repositories into a graph"

    def arguments(self, parser):
        parser.add_argument("repos", nargs="+", help="addresses of GitHub or GitLab repositories")
        parser.add_argument("-m", "--mapping", required=True, help="a mapping with {{GITHUB_SOURCE}} and {{GITLAB_SOURCE}} for the fetched files")
        parser.add_argument("-o", "--output")
        parser.add_argument("--explain", action="store_true")

    def run(self, args):
        kinds = {"GITHUB": [u for u in args.repos if "github.com" in u], "GITLAB": [u for u in args.repos if "gitlab" in u]}
        if not any(kinds.values()):
            log.error("no address of a GitHub or GitLab repository")
            return 1
        with open(args.mapping, encoding="utf-8") as f:
            text = f.read()
        with tempfile.TemporaryDirectory(prefix="kgspark-") as folder:
            for kind, urls in kinds.items():
                merged: list = []
                for url in urls:
                    try:
                        got = get_json(issues_url(url))
                        merged += got if isinstance(got, list) else []
                    except (OSError, ValueError) as e:
                        log.error("no issues from %s: %s", url, e)
                path = os.path.join(folder, f"{kind.lower()}.json")
                with open(path, "w", encoding="utf-8") as f:
                    json.dump(merged, f, ensure_ascii=False)
                text = text.replace("{{" + kind + "_SOURCE}}", path)
            mapping = os.path.join(folder, "mapping.ttl")
            with open(mapping, "w", encoding="utf-8") as f:
                f.write(text)
            return run_mapping(mapping, args.output, args.explain)


def _dates(start: int | None, end: int | None) -> dict:
    bounds = [f"from_publication_date:{start}-01-01"] * bool(start) + [f"to_publication_date:{end}-12-31"] * bool(end)
    return {"filter": ",".join(bounds)} if bounds else {}


def _openalex(author: str, start: int | None, end: int | None) -> list[dict]:
    common = {"per-page": 200, "sort": "publication_date:desc"} | _dates(start, end)
    ways = ({"search": f"authorships.author.display_name:{author}"}, {"search": f"author.display_name:{author}"}, {"search": author}, {"query": author})
    return [common | way for way in ways]


def _hal(author: str, *_) -> list[dict]:
    return [{"q": f'authFullName_t:"{author}"', "wt": "json", "rows": 200} | more for more in ({}, {"start": 0, "rows": 500})]


def _dblp(author: str, *_) -> list[dict]:
    return [{"q": author, "format": "json", "h": 200}]


def _serpapi(author: str, *_) -> list[dict]:
    key = os.environ.get("SERPAPI_API_KEY") or os.environ.get("SERPAPI_KEY")
    return [{"q": author, "engine": "google_scholar", "api_key": key}] if key else []


#: Service: the file's name, the address, its parameters (each but the first tried when those before find nothing), the path to the records and the fields of a record's year.
ARTICLES = {
    "openalex": ("openalex_works.json", "https://api.openalex.org/works", _openalex, ("results",), ("publication_year",)),
    "hal": ("hal_results.json", "https://api.archives-ouvertes.fr/search/", _hal, ("response", "docs"), ("producedDateY_i", "pubYear", "producedDateY")),
    "dblp": ("dblp_results.json", "https://dblp.org/search/publ/api", _dblp, ("result", "hits", "hit"), ("info.year",)),
    "serpapi": ("serpapi_scholar.json", "https://serpapi.com/search.json", _serpapi, ("organic_results",), ()),
}


def records(data, service: str) -> list:
    for step in ARTICLES[service][3]:
        data = data.get(step) if isinstance(data, dict) else None
    return data if isinstance(data, list) else []


def fetched(service: str, author: str, start: int | None, end: int | None):
    """The first answer that has records, else the last one; None if there is none at all."""
    _, url, ways, _, _ = ARTICLES[service]
    got = None
    for params in ways(author, start, end):
        try:
            answer = get_json(url, params)
        except (OSError, ValueError) as e:
            log.warning("nothing from %s: %s", service, e)
            continue
        got = answer
        if records(got, service):
            break
    return got


def in_years(record: dict, fields: tuple[str, ...], start: int | None, end: int | None) -> bool:
    """A record without a year that can be read passes."""
    for field in fields:
        value = record
        for step in field.split("."):
            value = value.get(step) if isinstance(value, dict) else None
        try:
            return (start is None or int(value) >= start) and (end is None or int(value) <= end)
        except (TypeError, ValueError):
            continue
    return True


def filtered(data, service: str, start: int | None, end: int | None):
    """data with those records only whose year is within bounds."""
    *way, last = ARTICLES[service][3]
    at = data
    for step in way:
        at = at.get(step, {}) if isinstance(at, dict) else {}
    if isinstance(at, dict) and isinstance(at.get(last), list):
        at[last] = [r for r in at[last] if in_years(r, ARTICLES[service][4], start, end)]
    return data


class ListArticles(Command):
    name, help = "list-articles", "fetch an author's articles and run a mapping over them"

    def arguments(self, parser):
        parser.add_argument("author")
        parser.add_argument("-m", "--mapping", required=True, help="a mapping that reads data/<service file> beside it")
        parser.add_argument("--start-year", type=int)
        parser.add_argument("--end-year", type=int)
        parser.add_argument("--outdir")
        parser.add_argument("--sources", default=",".join(ARTICLES))
        parser.add_argument("--explain", action="store_true")

    def run(self, args):
        folder = os.path.dirname(os.path.abspath(args.mapping))
        data = os.path.join(folder, "data")
        os.makedirs(data, exist_ok=True)
        for service in (s.strip().lower() for s in args.sources.split(",")):
            if service not in ARTICLES:
                log.warning("no such service: %s", service)
                continue
            got = fetched(service, args.author, args.start_year, args.end_year)
            if got is None:
                continue
            with open(os.path.join(data, ARTICLES[service][0]), "w", encoding="utf-8") as f:
                json.dump(filtered(got, service, args.start_year, args.end_year), f, ensure_ascii=False)
        name = re.sub(r"[^A-Za-z0-9._-]", "_", args.author.strip()) or "articles"
        return run_mapping(args.mapping, os.path.join(args.outdir or folder, f"{name}.nq"), args.explain)
