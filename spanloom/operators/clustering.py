"""Taking quarantined sequences out of a search result, and the external tool's command lines.

The filtering is done on tables. Searching and clustering are the external tool's; this module builds
its commands and can run them.
"""

from __future__ import annotations

import json
import shutil
import subprocess
from collections.abc import Iterable
from datetime import UTC, datetime
from inspect import Parameter, signature
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.schemas import InputError
from spanloom.sources.readers import read_id_list, read_lookup

# Fields of the exported table, and the tool's parameters.
EXPORT_FIELDS = "query,target,pident,alnlen,qstart,qend,qlen,tstart,tend,tlen,qcov,tcov,evalue,bits"
SEARCH_TYPE_NUCLEOTIDE, ALIGNMENT_MODE_COVERAGE_AND_IDENTITY, COVERAGE_OF_TARGET, CLUSTER_BY_LENGTH = 3, 3, 1, 2
CLUSTER_MODES = (0, 1, 2, 3)


# -- filtering ------------------------------------------------------------------------------------


def missing_ids(lookup: DataFrame, quarantined: DataFrame) -> DataFrame:
    return quarantined.select("contig_id").join(lookup.select("contig_id"), "contig_id", "left_anti")


def split_keys(lookup: DataFrame, quarantined: DataFrame, *, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """sequence_key of retained and of quarantined sequences. Ids that the lookup lacks are an error."""
    if check and (lost := missing_ids(lookup, quarantined).orderBy("contig_id").limit(3).collect()):
        raise InputError(f"quarantined ids that the lookup lacks: {[r.contig_id for r in lost]}")
    ids = quarantined.select("contig_id").distinct()
    return lookup.join(ids, "contig_id", "left_anti").select("sequence_key"), lookup.join(ids, "contig_id", "left_semi").select("sequence_key")


def filtered_alignments(alignments: DataFrame, quarantined: DataFrame) -> DataFrame:
    """Alignments neither of whose sequences is quarantined."""
    ids = quarantined.select(F.col("contig_id").alias("__id")).distinct()
    out = alignments
    for side in ("query_id", "target_id"):
        out = out.join(ids, out[side] == F.col("__id"), "left_anti")
    return out


# -- commands -------------------------------------------------------------------------------------


def _command(tool: str, verb: str, *places, threads: int | None = None, **options) -> list[str]:
    args = [tool, verb, *map(str, places)]
    for name, value in options.items():
        args += [f"-{name}" if len(name) == 1 else f"--{name.replace('_', '-')}", str(value)]
    return args + (["--threads", str(threads)] if threads else [])


def _places(out: Path) -> dict[str, Path]:
    """Where a run leaves its results."""
    return {"sequences": out / "db/sequences", "hits": out / "db/hits", "clusters": out / "db/clusters", "heads": out / "db/heads", "members": out / "members.tsv", "fasta": out / "heads.fasta"}


def search_commands(contigs: Path, out: Path, scratch: Path, *, tool: str = "mmseqs", threads: int = 32, identity: float = 0.9, length: int = 300, target_coverage: float = 0.8, sensitivity: float = 7.5, max_hits: int = 1_000, max_length: int = 1_000_000, reuse_database: bool = False) -> tuple[list[list[str]], dict[str, Path]]:
    """Commands of a search of all against all and its clustering, and where their results are."""
    at = _places(out)
    db, hits = at["sequences"], at["hits"]
    create = _command(tool, "createdb", contigs, db, threads=threads)
    search = _command(tool, "search", db, db, hits, scratch / "search", search_type=SEARCH_TYPE_NUCLEOTIDE, alignment_mode=ALIGNMENT_MODE_COVERAGE_AND_IDENTITY, min_seq_id=identity, min_aln_len=length, c=target_coverage, cov_mode=COVERAGE_OF_TARGET, s=sensitivity, max_seqs=max_hits, max_seq_len=max_length, threads=threads) + ["--remove-tmp-files", "1"]
    return [*([] if reuse_database else [create]), search, *cluster_commands(db, hits, at, tool=tool, threads=threads, mode=CLUSTER_BY_LENGTH)], at


def cluster_commands(db: Path, hits: Path, at: dict[str, Path], *, tool: str, threads: int, mode: int) -> list[list[str]]:
    if mode not in CLUSTER_MODES:
        raise InputError(f"cluster mode must be one of {CLUSTER_MODES}")
    clusters = at["clusters"]
    return [
        _command(tool, "clust", db, hits, clusters, cluster_mode=mode, threads=threads),
        _command(tool, "createtsv", db, db, clusters, at["members"], threads=threads),
        _command(tool, "createsubdb", clusters, db, at["heads"]),
        _command(tool, "convert2fasta", at["heads"], at["fasta"]),
    ]


def recluster_commands(db: Path, hits: Path, out: Path, *, any_quarantined: bool, tool: str = "mmseqs", threads: int = 32, mode: int = CLUSTER_BY_LENGTH) -> tuple[list[list[str]], dict[str, Path]]:
    """Commands that keep the allowed queries, drop quarantined targets, and cluster what is left.

    ``at["hits"]`` is the filtered result in either case; without quarantined sequences there are no
    targets to drop, and no table between.
    """
    at = _places(out) | {"kept_keys": out / "kept.keys", "gone_keys": out / "gone.keys"}
    steps = [_command(tool, "createsubdb", at["kept_keys"], db, at["sequences"])]
    if any_quarantined:
        at["hits_of_kept_queries"] = out / "db/hits-of-kept-queries"
        steps.append(_command(tool, "createsubdb", at["kept_keys"], hits, at["hits_of_kept_queries"]))
        steps.append(_command(tool, "filterdb", at["hits_of_kept_queries"], at["hits"], filter_file=at["gone_keys"], filter_column=1, positive_filter=0, threads=threads))
    else:
        steps.append(_command(tool, "createsubdb", at["kept_keys"], hits, at["hits"]))
    return steps + cluster_commands(at["sequences"], at["hits"], at, tool=tool, threads=threads, mode=mode), at


def export_command(db: Path, hits: Path, tsv: Path, *, tool: str = "mmseqs", threads: int = 32) -> list[str]:
    return _command(tool, "convertalis", db, db, hits, tsv, format_output=EXPORT_FIELDS, threads=threads)


def run_commands(commands: list[list[str]]) -> None:
    """Run the commands one after another; the first that fails ends it."""
    for c in commands:
        if not shutil.which(c[0]):
            raise FileNotFoundError(f"no such program: {c[0]}")
        subprocess.run(c, check=True)


# -- runs -----------------------------------------------------------------------------------------


def _parts(place: Path) -> list[Path]:
    """Files of a database: its data, whole or in numbered parts, and what goes with it."""
    place = Path(place)
    return [p for p in place.parent.glob(f"{place.name}*") if p.name == place.name or p.name[len(place.name)] == "."] if place.parent.is_dir() else []


def database_exists(place: Path) -> bool:
    """Whether the tool's database is there: its data and its type. One of which only some files are there is an error."""
    there = _parts(place)
    whole = Path(f"{place}.dbtype").exists() and any(p == Path(place) or p.name[len(Path(place).name) + 1 :].isdigit() for p in there)
    if there and not whole:
        raise FileExistsError(f"{place} is incomplete: {sorted(p.name for p in there)}")
    return whole


def _lines(path: Path, prefix: str = "") -> int:
    with Path(path).open(encoding="utf-8") as f:
        return sum(1 for line in f if line.startswith(prefix) and line.strip())


def _finish(commands: list[list[str]], at: dict[str, Path], manifest: Path, **more) -> dict:
    run_commands(commands)
    for name in ("members", "fasta"):
        if not at[name].exists():
            raise RuntimeError(f"the tool made no {at[name]}")
    out = {"created_at": datetime.now(UTC).isoformat(), "commands": commands, "outputs": {k: str(v) for k, v in at.items()}, "members": _lines(at["members"]), "representatives": _lines(at["fasta"], ">"), **more}
    manifest.write_text(json.dumps(out, indent=2, sort_keys=True) + "\n", encoding="utf-8")
    return out


def run_search(contigs: Path, out: Path, scratch: Path, **options) -> dict:
    """Search all against all and cluster; a sequence database that is there is used again."""
    contigs, out = Path(contigs), Path(out)
    if not contigs.is_file():
        raise FileNotFoundError(contigs)
    reuse = database_exists(_places(out)["sequences"])
    commands, at = search_commands(contigs, out, Path(scratch), reuse_database=reuse, **options)
    if left := [str(p) for n, p in at.items() if n != "sequences" and _parts(p)]:
        raise FileExistsError(f"results of an earlier run: {left}")
    for d in (out / "db", Path(scratch)):
        d.mkdir(parents=True, exist_ok=True)
    settings = {k: v.default for k, v in signature(search_commands).parameters.items() if v.kind is Parameter.KEYWORD_ONLY} | options | {"reuse_database": reuse}
    return _finish(commands, at, out / "search.manifest.json", settings=settings)


def run_export(db: Path, hits: Path, tsv: Path, **options) -> Path:
    """Export a search result as the 14-column table."""
    if Path(tsv).exists():
        raise FileExistsError(tsv)
    run_commands([export_command(db, hits, tsv, **options)])
    return Path(tsv)


def write_keys(path: Path, keys: Iterable[str]) -> int:
    """One key a line, as the tool reads them; streamed."""
    n = 0
    with Path(path).open("w", encoding="utf-8") as f:
        for k in keys:
            f.write(f"{k}\n")
            n += 1
    return n


def run_recluster(spark: SparkSession, db: Path, hits: Path, quarantine: Path, out: Path, **options) -> dict:
    """Take quarantined sequences out of a search result and cluster what is left. ``out`` is new or empty."""
    out = Path(out)
    for place in (db, hits):
        if not database_exists(place):
            raise FileNotFoundError(place)
    if out.exists() and any(out.iterdir()):
        raise FileExistsError(out)
    kept, gone = split_keys(read_lookup(spark, f"{db}.lookup"), read_id_list(spark, quarantine))
    (out / "db").mkdir(parents=True, exist_ok=True)
    n_kept, n_gone = (write_keys(out / name, (r.sequence_key for r in keys.orderBy("sequence_key").toLocalIterator())) for name, keys in (("kept.keys", kept), ("gone.keys", gone)))
    if not n_kept:
        raise InputError("quarantine leaves no sequence")
    commands, at = recluster_commands(Path(db), Path(hits), out, any_quarantined=n_gone > 0, **options)
    return _finish(commands, at, out / "recluster.manifest.json", retained=n_kept, quarantined=n_gone)
