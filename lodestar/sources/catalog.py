"""Versions: where their parts lie, which are ready, and their removal."""

from __future__ import annotations

import io
import os
import re
import shutil
import urllib.request
import zipfile
from dataclasses import asdict, dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import SUFFIXES, listed_tree


def safe_name(version: str) -> str:
    """Letters, digits and ._- only."""
    name = "".join(c for c in version if c.isalnum() or c in "._-")
    if not name:
        raise ValueError("a version needs a letter or digit")
    return name


@dataclass(frozen=True)
class Paths:
    """The places of a version below the data directory."""

    base: str

    @classmethod
    def of(cls, data: str, version: str) -> Paths:
        return cls(f"{data}/versions/{safe_name(version)}")

    @property
    def source(self) -> str:
        return f"{self.base}/source"

    @property
    def analysis(self) -> str:
        return f"{self.base}/analysis"

    @property
    def lexical(self) -> str:
        return f"{self.base}/lexical"

    @property
    def vectors(self) -> str:
        return f"{self.base}/vectors"

    @property
    def contents(self) -> str:
        return f"{self.base}/contents"

    @property
    def ranked(self) -> str:
        return f"{self.base}/ranked.jsonl"

    @property
    def checkpoints(self) -> str:
        return f"{self.base}/checkpoints"


def work_root(path: str, markers: tuple[str, str] = ("fndbas", "order")) -> str:
    """Descend single folders until one holds both markers; several folders without them are an error."""
    while not all(os.path.isdir(f"{path}/{m}") for m in markers):
        inner = [e.path for e in os.scandir(path) if e.is_dir()]
        if len(inner) != 1:
            raise ValueError(f"{path} holds {len(inner)} folders and not {' and '.join(markers)}")
        path = inner[0]
    return path


@dataclass(frozen=True)
class Status:
    version: str
    extract_path: str
    analysis_path: str
    lexical_path: str
    vectors_path: str
    ranked_path: str
    has_analysis: bool
    has_lexical: bool
    has_vectors: bool
    has_pagerank: bool
    has_hybrid_search: bool
    has_full_analysis: bool
    is_ready: bool
    file_count: int
    created: str


def versions(data: str, counts: dict[str, int] | None = None) -> list[Status]:
    """All versions, the newest first; of those of one moment the first by name. counts: how many source files each
    has; without it they are walked here."""
    out = []
    root = f"{data}/versions"
    names = os.listdir(root) if os.path.isdir(root) else []
    for name in sorted(names, key=lambda n: (-os.stat(f"{root}/{n}").st_ctime_ns, n)):
        p = Paths(f"{root}/{name}")
        filled = lambda d: os.path.isdir(d) and bool(os.listdir(d))
        analysis, lexical, vectors, ranked = filled(p.analysis), filled(p.lexical), filled(p.vectors), os.path.exists(p.ranked)
        files = _source_files(p.base) if counts is None else counts.get(name, 0)
        created = datetime.fromtimestamp(os.stat(p.base).st_ctime).strftime("%Y-%m-%d %H:%M:%S")
        out.append(Status(name, p.base, p.analysis, p.lexical, p.vectors, p.ranked, analysis, lexical, vectors, ranked, lexical and ranked, analysis and lexical and ranked, lexical and ranked, files, created))
    return out


def _source_files(folder: str) -> int:
    """How many source files lie below a folder, whose names are seen one by one."""
    with os.scandir(folder) as found:
        return sum(_source_files(e.path) if e.is_dir(follow_symlinks=False) else e.name.endswith(SUFFIXES) for e in found)


def version_table(spark: SparkSession, data: str) -> DataFrame:
    """All versions as rows; tasks count their source files."""
    path = F.col("relative_path")
    sources = listed_tree(spark, f"{data}/versions").where(path.contains("/") & reduce(Column.__or__, [path.endswith(x) for x in SUFFIXES]))
    counts = {r["version"]: r["n"] for r in sources.groupBy(F.split_part("relative_path", F.lit("/"), F.lit(1)).alias("version")).agg(F.count("*").alias("n")).collect()}  # a row a version
    rows = [asdict(s) for s in versions(data, counts)]
    fields = ", ".join(f"{n} {'boolean' if n.startswith(('has', 'is')) else 'int' if n == 'file_count' else 'string'}" for n in Status.__dataclass_fields__)
    return spark.createDataFrame([tuple(r.values()) for r in rows], fields)


def delete_version(data: str, version: str, confirmed: bool = False) -> bool:
    """Remove a version's folder, only if confirmed."""
    path = Paths.of(data, version).base
    if not confirmed or not os.path.isdir(path):
        return False
    shutil.rmtree(path)
    return True


def matching_release(releases: list[dict], version: str) -> dict | None:
    """The first release with a lexical and a vector asset of exactly this version, or one archive that holds both."""
    for r in releases:
        names = {a["name"].lower() for a in r.get("assets", [])}
        has = lambda part: any(re.fullmatch(rf"(?:v?){re.escape(version.lower())}-{part}\.zip", n) for n in names)  # noqa: E731, B023
        if f"{version.lower()}.zip" in names or (has("lexical") and has("vectors")):
            return r
    return None


def package(data: str, version: str) -> dict[str, float | str]:
    """Pack a version's publishable files (publishable()) and a manifest into <version>.zip in its folder: path, sizes
    and by how many per cent the archive is smaller. Index files are few; they are read one by one."""
    base = Paths.of(data, version).base
    found = [(os.path.relpath(os.path.join(folder, n), base), describe_artifact(f"{folder}/{n}")) for folder, _, names in os.walk(base) for n in sorted(names)]
    chosen = sorted((p, d) for p, d in found if d is not None and not p.endswith(".zip"))
    if not chosen:
        raise ValueError(f"nothing to publish in {base}")
    target, original = f"{base}/{safe_name(version)}.zip", 0
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED, compresslevel=9) as z:
        for path, _ in chosen:
            z.write(f"{base}/{path}", path)
            original += os.path.getsize(f"{base}/{path}")
        z.writestr("README.txt", f"Version {version}: indexes and rankings, no source text\n\n" + "".join(f"- {p} - {d}\n" for p, d in chosen))
    size = os.path.getsize(target)
    return {"path": target, "files": len(chosen), "original_size": original, "size": size, "smaller_by_percent": (1 - size / original) * 100 if original else 0.0}


def describe_artifact(path: str) -> str | None:
    """What a file of a version is, if it may be published; the rule of files.publishable() for one path."""
    parts = path.split("/")
    if "vectors" in parts:
        return "vector table"
    if "lexical" in parts:
        return f"lexical index, {parts[parts.index('lexical') + 1]}" if len(parts) > parts.index("lexical") + 1 else None
    return "file ranking" if any(p == "ranked.jsonl" for p in parts) else None


def download(releases: list[dict], version: str, data: str) -> Status:
    """Fetch the archives of the first release that holds all of a version's indexes (matching_release) and unpack them
    into its folder; names that would leave the folder are an error."""
    release = matching_release(releases, version)
    if release is None:
        raise ValueError(f"no release holds the indexes of {version}")
    base = Paths.of(data, version).base
    for asset in release["assets"]:
        if re.fullmatch(rf"v?{re.escape(version.lower())}(-lexical|-vectors)?\.zip", asset["name"].lower()):
            with urllib.request.urlopen(asset["browser_download_url"]) as r, zipfile.ZipFile(io.BytesIO(r.read())) as z:
                for e in z.infolist():
                    if e.filename.startswith("/") or "\\" in e.filename or ".." in e.filename.split("/") or re.match("[A-Za-z]:", e.filename):
                        raise ValueError(f"unsafe name in the archive: {e.filename!r}")
                z.extractall(base)
    return next(s for s in versions(data) if s.extract_path == base)
