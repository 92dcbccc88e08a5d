"""Commands: preprocess, call, simulate. A configuration has a key and values per line; # begins a comment."""

from __future__ import annotations

import argparse
import dataclasses
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import coverage
from ..operators.simulate import simulate_fragments
from ..operators.staged import staged
from ..sources import reads, sinks
from .calls import Run, Settings

#: Keys of the configuration and the fields they set.
KEYS = {"Enrichment_mapped_fragment_length": ("ext", int), "target_FDR": ("fdr", float), "max_Qvalue": ("max_q", float), "N_Simulations": ("sims", int), "Minimum_interpeak_distance": ("gap", int), "Simulation_seed": ("seed", int), "Background_model": ("model", str), "Max_threshold": ("max_threshold", int)}
#: Key of the folder for the peaks' profiles.
PROFILES = "Peak_profile_output_dir"
REQUIRED = [*[k for k in KEYS if k not in ("Simulation_seed", "Max_threshold")], "Mappability_map_file", "ChIP_Seq_reads_data_dirs", "Input_reads_data_dirs", "Experiment_id"]


def read_config(lines: list[str]) -> dict[str, list[str]]:
    """The first line with a key counts; lines without a value are skipped."""
    out: dict[str, list[str]] = {}
    for line in lines:
        key, *values = line.split() or [""]
        if values and not line.startswith("#"):
            out.setdefault(key, values)
    return out


def settings_of(config: dict[str, list[str]]) -> Settings:
    missing = [k for k in REQUIRED if k not in config]
    if missing:
        raise ValueError(f"missing keys: {', '.join(missing)}")
    if config["Background_model"][0] not in ("Poisson", "Simulated"):
        raise ValueError("Background_model is Poisson or Simulated")
    if not 0 < float(config["target_FDR"][0]) < 1:
        raise ValueError("target_FDR lies between 0 and 1")
    return Settings(**{f: kind(config[k][0]) for k, (f, kind) in KEYS.items() if k in config})


def call(spark: SparkSession, config: dict[str, list[str]], out: str) -> None:
    """Writes the result text, the narrowPeak lines, the peaks' profiles if a folder for them is named, and a row about the run."""
    began = time.time()
    both = [reads.read_pool(spark, config[k]).withColumn("sample", F.lit(s)) for k, s in (("ChIP_Seq_reads_data_dirs", "chip"), ("Input_reads_data_dirs", "control"))]
    given = spark.read.schema("chrom string, win bigint, n_mappable bigint").csv(config["Mappability_map_file"][0], sep=" ") if config["Mappability_map_file"][0] != "none" else None
    settings, name = settings_of(config), config["Experiment_id"][0]
    run = Run(both[0].unionByName(both[1]), settings, reads.fill_mappability(given) if given is not None else None)
    found = staged(run.called(), "called").orderBy("q", "log_p", "chrom", "start")
    sinks.write_lines(sinks.result_lines(found), f"{out}/{name}", title=True)
    sinks.write_lines(sinks.narrowpeak_lines(found), config.get("narrowPeak_output_file_path", [f"{out}/{name}_narrowPeak"])[0])
    if PROFILES in config:
        sinks.write_peak_profiles(sinks.peak_profiles(found, coverage.segments(run.profile)), config[PROFILES][0])
    about = {"experiment": name, **dataclasses.asdict(settings), "peaks": found.count(), "seconds": round(time.time() - began, 3)}
    spark.createDataFrame([about]).write.mode("append").json(f"{out}/{name}_runs")
    run.release()


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="tidepool")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, params in {"preprocess": ["format", "path", "out"], "call": ["config", "out"], "simulate": ["bed", "n_chip", "n_control", "length", "chip_out", "control_out"]}.items():
        sub = commands.add_parser(name)
        for p in params:
            sub.add_argument(p)
    commands.choices["preprocess"].add_argument("--read-ids", action="store_true", help="keep the reads' names")
    a = parser.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    if a.command == "preprocess":
        reads.preprocess(spark, a.format, a.path, a.out, a.read_ids)
    elif a.command == "call":
        call(spark, read_config([r["value"] for r in spark.read.text(a.config).collect()]), a.out)
    else:
        regions = reads.parse_bed(reads.read_lines(spark, a.bed)).withColumn("key", F.pmod(F.xxhash64("chrom", "start", "end"), F.lit(2**30)))
        for n, chip, out in ((a.n_chip, True, a.chip_out), (a.n_control, False, a.control_out)):
            sinks.write_tsv(sinks.tagalign_rows(simulate_fragments(regions, int(n), int(a.length), Settings.seed, chip)), out)


if __name__ == "__main__":
    main()
