"""Where imported modules lie."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Hosts whose addresses are host/owner/repository[/folder][#ref]; fixed values.
HOSTS = ("github.com", "gitlab.com", "bitbucket.org")
SUFFIX = ".loom"


@dataclass(frozen=True)
class Address:
    host: str
    owner: str
    repository: str
    folder: str
    ref: str


def is_local(url: str) -> bool:
    return url.startswith((".", "/"))


def parse_url(url: str) -> Address:
    body, _, ref = url.partition("#")
    parts = [p for p in body.split("/") if p]
    if len(parts) < 3 or parts[0] not in HOSTS:
        raise ValueError(f"not an import address: {url} (expected host/owner/repository, with {', '.join(HOSTS)})")
    return Address(parts[0], parts[1], parts[2], "/".join(parts[3:]), ref)


def url_columns(url: Column) -> Column:
    """parse_url as a struct column; null for local paths and unknown hosts."""
    body, parts = F.substring_index(url, "#", 1), F.filter(F.split(F.substring_index(url, "#", 1), "/"), lambda p: p != "")
    ref = F.when(F.contains(url, F.lit("#")), F.substring(url, F.length(body) + 2, F.length(url))).otherwise(F.lit(""))
    fields = F.struct(parts[0].alias("host"), F.get(parts, F.lit(1)).alias("owner"), F.get(parts, F.lit(2)).alias("repository"), F.array_join(F.slice(parts, 4, F.greatest(F.size(parts), F.lit(1))), "/").alias("folder"), ref.alias("ref"))
    return F.when((F.size(parts) >= 3) & F.get(parts, F.lit(0)).isin(*HOSTS), fields)


def module_folders(url: str, root: str) -> dict[str, str]:
    """name: file of the modules below an import's folder; later imports replace earlier ones. Remote ones are read from a clone that is already below root/.blockloom/imports."""
    if is_local(url):
        base = os.path.join(root, url)
    else:
        a = parse_url(url)
        base = os.path.join(root, ".blockloom", "imports", a.host, a.owner, a.repository, a.folder)
    if not os.path.isdir(base):
        raise ValueError(f"no modules at {url} ({base})")
    out = {}
    for name in sorted(os.listdir(base)):
        path = os.path.join(base, name)
        if name.endswith(SUFFIX):
            out[name.removesuffix(SUFFIX)] = path
        elif os.path.isfile(os.path.join(path, name + SUFFIX)):
            out[name] = os.path.join(path, name + SUFFIX)
    return out
