"""Labels, ids and names that rows carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Codes of operations within a label.
OPERATION_CODES = {"linear_filter": "LF", "nonlinear_distortion": "NL", "additive_noise": "AN", "gain_variation": "GV", "clipping": "CL"}
# Prefixes of audio ids by split.
SPLIT_PREFIX = {"train": "LA_T", "val": "LA_D", "test": "LA_E"}
# Countries and genders by code.
COUNTRIES = {"ar": "Argentina", "cl": "Chile", "co": "Colombia", "pe": "Peru", "ve": "Venezuela"}
GENDERS = {"f": "Female", "m": "Male"}
ATTACKS = ("CycleGAN", "StarGAN", "Diff", "TTS")
COUNTRY_PATTERN = "^(ar|cl|co|pe|ve)"


def lookup(values: dict[str, str], key: Column, default: Column | str) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(pairs[key], F.lit(default) if isinstance(default, str) else default)


def rir_label(room: Column, noise: Column, snr: Column) -> Column:
    """RIR_{room}_{three letters}_SNR{whole dB, cut towards zero}."""
    return F.concat(F.lit("RIR_"), F.upper(F.regexp_replace(room, "room", "")), F.lit("_"), F.upper(F.substring(noise, 1, 3)), F.lit("_SNR"), snr.cast("int").cast("string"))


def codec_label(rate: Column, loss: Column, bandpass: Column, bits: Column) -> Column:
    return F.concat(
        F.lit("CODEC_"), (rate / 1000).cast("int").cast("string"), F.lit("K_LOSS"), (loss * F.lit(100.0)).cast("int").cast("string"), F.lit("PCT"),
        F.when(bandpass, F.lit("_BP")).otherwise(""), F.when(bits > 0, F.concat(F.lit("_Q"), bits.cast("string"))).otherwise(""),
    )


def rawboost_label(operations: Column) -> Column:
    codes = F.transform(operations, lambda o: lookup(OPERATION_CODES, o, F.upper(F.substring(o, 1, 2))))
    return F.concat(F.lit("RAWBOOST_"), F.when(F.size(operations) == 0, F.lit("NONE")).otherwise(F.array_join(codes, "_")))


def parse_label(label: Column) -> Column:
    """The parts of a label, whichever of the grammars it follows; '-' is clean, others are null."""
    def part(p: str, i: int = 1) -> Column:
        got = F.regexp_extract(label, p, i)
        return F.when(got != "", got)

    return F.struct(
        F.when(label == "-", "clean").otherwise(F.lower(part("^(RIR|CODEC|RAWBOOST)_"))).alias("kind"),
        F.lower(part("^RIR_([A-Z]+)_[A-Z]{3}_SNR")).alias("room"), F.lower(part("^RIR_[A-Z]+_([A-Z]{3})_SNR")).alias("noise"), part("_SNR(-?[0-9]+)$").cast("int").alias("snr_db"),
        part("^CODEC_([0-9]+)K").cast("int").alias("khz"), part("LOSS([0-9]+)PCT").cast("int").alias("loss_pct"),
        F.when(label.startswith("CODEC_"), label.contains("_BP")).alias("bandpass"), part("_Q([0-9]+)$").cast("int").alias("bits"),
        F.when(label.startswith("RAWBOOST_"), F.filter(F.split(F.regexp_replace(label, "^RAWBOOST_", ""), "_"), lambda x: x != "NONE")).alias("operations"),
    )


def audio_id(prefix: Column, index: Column) -> Column:
    return F.format_string("%s_%07d", prefix, index)


def seven_digits(audio_id: Column) -> Column:
    """A protocol's id as lpad(index, 7, '0') writes it: of a longer index the first seven digits, so ids beyond 9,999,999 repeat."""
    return F.substring(audio_id, 1, len("LA_T_") + 7)


def protocol_line(*fields: str) -> Column:
    return F.concat_ws(" ", *fields)


def output_name(factor: Column, ratio: Column) -> Column:
    """augmented_{f}_balanced_{r}{1-r}, both cut to whole hundredths in double arithmetic."""
    return F.concat(F.lit("augmented_"), factor, F.lit("_balanced_"), (ratio * F.lit(100.0)).cast("int").cast("string"), ((F.lit(1.0) - ratio) * F.lit(100.0)).cast("int").cast("string"))


def parse_filename(name: Column) -> Column:
    """STRUCT<is_synthetic, attack_type, voice_ids, num_speakers> of a corpus file name; repeated ids stay."""
    attack = F.when(F.lit(False), "")
    for a in ATTACKS:
        attack = attack.when(name.startswith(f"{a}-"), F.lit(a))
    rest = F.regexp_replace(F.regexp_replace(name, "\\.wav$", ""), "^(CycleGAN|StarGAN|Diff|TTS)-", "")
    ids = F.transform(F.split(rest, "-"), lambda s: F.concat_ws("_", F.slice(F.split(s, "_"), 1, 2)))
    ids = F.filter(ids, lambda s: s.rlike("^(ar|cl|co|pe|ve)[^_]+_"))
    return F.struct(attack.isNotNull().alias("is_synthetic"), attack.alias("attack_type"), ids.alias("voice_ids"), F.size(ids).alias("num_speakers"))


def list_line_ids(line: Column) -> Column:
    """Distinct ids of a list line: parts lie between attack prefixes, not between hyphens."""
    parts = F.split(F.regexp_replace(F.regexp_replace(line, "\\.wav$", ""), "(CycleGAN|StarGAN|Diff|TTS)-", "|"), "\\|")
    ids = F.transform(parts, lambda s: F.concat_ws("_", F.slice(F.split(s, "_"), 1, 2)))
    return F.array_distinct(F.filter(ids, lambda s: s.rlike("^(ar|cl|co|pe|ve)[^_]+_")))


def country(speaker: Column) -> Column:
    return lookup(COUNTRIES, F.lower(F.substring(speaker, 1, 2)), "unknown")


def gender(speaker: Column) -> Column:
    return F.when(F.length(speaker) > 2, lookup(GENDERS, F.lower(F.substring(speaker, 3, 1)), "Unknown")).otherwise("Unknown")


def file_type(filename: Column) -> Column:
    return F.when(filename.startswith("bonafide_"), "bonafide").otherwise("spoof")


def folder_country(folder: Column) -> Column:
    return F.when(F.lower(folder) == "chile", "cl").otherwise(F.lower(F.substring(folder, 1, 2)))


def valid_name(filename: Column) -> Column:
    """bonafide_* needs three parts, spoof_* four; nothing else is valid."""
    parts = F.size(F.split(F.regexp_replace(filename, "\\.wav$", ""), "_"))
    return F.when(filename.startswith("bonafide_"), parts >= 3).when(filename.startswith("spoof_"), parts >= 4).otherwise(False)
