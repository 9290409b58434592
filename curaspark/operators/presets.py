"""Presets as dimension tables, and the joins that derive augmentation parameters from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from curaspark.operators.splits import uniform

# Devices (rate, bits, channels, band, noise floor, sensitivity, converter bits) and their surroundings
# (distances, SNR range, reverb level, numbers of noise and interference types).
DEVICES = [
    ("esp32_pdm", 16000, 16, 1, 100, 7000, -60.0, -26.0, 12, 0.5, 3.0, 5.0, 25.0, "medium", 3, 2),
    ("esp32_i2s", 16000, 24, 1, 60, 8000, -87.0, -26.0, 24, 0.5, 4.0, 10.0, 30.0, "medium", 3, 1),
    ("esp32_s3", 16000, 24, 1, 50, 8000, -90.0, -26.0, 24, 0.5, 5.0, 10.0, 35.0, "medium", 4, 2),
    ("rpi_usb", 16000, 16, 1, 80, 15000, -65.0, -30.0, 16, 0.3, 2.0, 15.0, 40.0, "low", 3, 2),
    ("rpi_i2s", 16000, 24, 1, 50, 15000, -85.0, -26.0, 24, 0.5, 4.0, 15.0, 40.0, "medium", 3, 1),
    ("rpi_hat", 16000, 24, 4, 40, 16000, -90.0, -26.0, 24, 1.0, 6.0, 10.0, 35.0, "high", 4, 1),
    ("smart_speaker_budget", 16000, 16, 2, 100, 12000, -60.0, -28.0, 16, 1.0, 4.0, 5.0, 25.0, "medium", 4, 2),
    ("smart_speaker_mid", 16000, 16, 4, 60, 14000, -72.0, -26.0, 24, 1.0, 5.0, 8.0, 30.0, "medium", 5, 1),
    ("smart_speaker_premium", 16000, 24, 7, 40, 16000, -90.0, -26.0, 24, 1.0, 7.0, 10.0, 35.0, "high", 5, 1),
    ("mobile_ios", 16000, 16, 1, 60, 15000, -80.0, -26.0, 16, 0.3, 1.5, 10.0, 40.0, "low", 4, 1),
    ("mobile_android", 16000, 16, 1, 80, 14000, -70.0, -28.0, 16, 0.3, 1.5, 8.0, 35.0, "low", 4, 2),
    ("jetson_nano", 16000, 16, 2, 50, 15000, -80.0, -26.0, 16, 0.5, 4.0, 15.0, 40.0, "medium", 3, 2),
    ("coral_dev", 16000, 16, 1, 60, 14000, -75.0, -26.0, 16, 0.5, 3.0, 15.0, 35.0, "low", 2, 1),
    ("low_power", 8000, 16, 1, 200, 3400, -55.0, -30.0, 12, 0.3, 1.5, 5.0, 20.0, "medium", 2, 2),
    ("far_field", 16000, 24, 4, 40, 16000, -85.0, -26.0, 24, 2.0, 8.0, 5.0, 25.0, "high", 5, 1),
    ("near_field", 16000, 16, 1, 80, 14000, -70.0, -26.0, 16, 0.1, 0.5, 20.0, 50.0, "low", 2, 2),
]
DEVICE_SCHEMA = (
    "device string, rate int, bits int, channels int, low_hz int, high_hz int, noise_floor_db double, sensitivity_dbfs double, adc_bits int, "
    "near_m double, far_m double, snr_low double, snr_high double, reverb string, noise_types int, interference_types int"
)
# Reverb levels, surroundings, rooms, microphones, telephone bands.
REVERB = [("low", 0.2, 15.0, 0.1), ("medium", 0.4, 35.0, 0.2), ("high", 0.7, 80.0, 0.35)]
ENVIRONMENTS = [
    ("morning_kitchen", "pink", 12.0, 20.0, 0.8, "medium_room", "smartphone"),
    ("evening_living_room", "brown", 15.0, 25.0, 0.3, "large_room", "lapel"),
    ("office_space", "white", 10.0, 18.0, 0.5, "office", "conference"),
    ("car_interior", "pink", 8.0, 15.0, 0.2, "small_room", "headset"),
    ("outdoor_park", "brown", 5.0, 12.0, 0.1, "large_room", "far_field"),
    ("bedroom_night", "white", 20.0, 30.0, 0.1, "medium_room", "studio"),
]
ROOMS = [
    ("small_room", 3.0, 2.5, 2.4, 0.3, 0.2, 3),
    ("medium_room", 5.0, 4.0, 2.8, 0.5, 0.15, 4),
    ("large_room", 8.0, 6.0, 3.0, 0.8, 0.1, 5),
    ("bathroom", 2.5, 2.0, 2.4, 1.2, 0.05, 4),
    ("living_room", 6.0, 4.5, 2.6, 0.4, 0.2, 4),
    ("office", 10.0, 8.0, 2.8, 0.3, 0.3, 3),
]
MICROPHONES = [
    ("smartphone", 0.15, -55.0, 24000),
    ("lapel", 0.08, -65.0, 24000),
    ("studio", 0.03, -80.0, 24000),
    ("conference", 0.12, -50.0, 16000),
    ("headset", 0.10, -60.0, 16000),
    ("far_field", 0.20, -45.0, 16000),
]
PHONES = [
    ("pstn_landline", 300, 3400, 8000),
    ("mobile_gsm", 200, 3400, 8000),
    ("mobile_hd", 50, 7000, 16000),
    ("voip_low", 200, 4000, 8000),
    ("voip_medium", 50, 8000, 16000),
    ("voip_high", 20, 12000, 24000),
    ("cordless_dect", 150, 6800, 16000),
]


# The devices of each category; the share of the strength by which each parameter varies, and how far.
CATEGORIES = {
    "microcontroller": ["esp32_pdm", "esp32_i2s", "esp32_s3"],
    "sbc": ["rpi_usb", "rpi_i2s", "rpi_hat"],
    "smart_speaker": ["smart_speaker_budget", "smart_speaker_mid", "smart_speaker_premium"],
    "mobile": ["mobile_ios", "mobile_android"],
    "embedded": ["jetson_nano", "coral_dev"],
    "generic": ["low_power", "far_field", "near_field"],
}
VARIATIONS = {"pitch_steps": (0.7, -1.0, 1.0), "rt60": (0.5, 0.8, 1.2), "distortion": (0.6, 0.7, 1.3)}


def category_of(device: Column) -> Column:
    """The category that lists a device; null for others."""
    held = None
    for name, members in CATEGORIES.items():
        held = F.when(device.isin(members), name) if held is None else held.when(device.isin(members), name)
    return held


def in_category(device_rows: DataFrame, category: str) -> DataFrame:
    """The rows whose device is of a category; none for an unknown category."""
    return device_rows.where(category_of(F.col("device")) == category)


def varied(profiles: DataFrame, key: Column | str, strength: float = 0.3, seed: int = 42) -> DataFrame:
    """Profiles with some parameters moved at random: pitch_steps by up to the strength either way, rt60 and distortion by a
    factor, never below 0.1 and 0.01. Each moves with a chance of its share of the strength, by seed and key alone; a null
    pitch counts as none, other nulls stay. Strengths from 0, which moves nothing, to 1."""
    if not 0 <= strength <= 1:
        raise ValueError(f"strength {strength} is not between 0 and 1")
    k = F.col(key) if isinstance(key, str) else key
    moves = lambda what: uniform(k, f"{what} moves", seed) < strength * VARIATIONS[what][0]
    drawn = lambda what: uniform(k, what, seed, *VARIATIONS[what][1:])
    scaled = lambda what, least: F.when(moves(what) & F.col(what).isNotNull(), F.greatest(F.lit(least), F.col(what) * drawn(what))).otherwise(F.col(what))
    return profiles.withColumns({
        "pitch_steps": F.when(moves("pitch_steps"), drawn("pitch_steps") * strength).otherwise(F.coalesce("pitch_steps", F.lit(0.0))),
        "rt60": scaled("rt60", 0.1),
        "distortion": scaled("distortion", 0.01),
    })


def with_profiles(known: DataFrame, own: DataFrame, rooms_: DataFrame, mics: DataFrame) -> DataFrame:
    """The environments with more rows of the same columns; ValueError where names repeat, ratios or densities make no sense,
    or a room or microphone is unknown. Names are put as ``custom_<name>`` in lower case with low lines for blanks."""
    named = own.withColumn("profile", F.concat(F.lit("custom_"), F.lower(F.translate("profile", " ", "_"))))
    held = named.join(rooms_.select("room", F.lit(True).alias("_room")), "room", "left").join(mics.select("mic", F.lit(True).alias("_mic")), "mic", "left")
    rules = {"snr": (F.col("snr_low") <= F.col("snr_high")) & F.col("snr_low").between(-10, 50), "events": F.col("events_per_minute") >= 0, "noise": F.col("noise").isin("white", "pink", "brown", "blue"), "room": F.col("_room"), "mic": F.col("_mic")}
    broken = rule_violations(held, "profile", rules).limit(5).collect()
    twice = known.select("profile").unionByName(named.select("profile")).groupBy("profile").count().where("count > 1").limit(5).collect()
    if broken or twice:
        told = [f"{r.profile}: {', '.join(r.violations)}" for r in broken] + [f"{r.profile}: name is taken" for r in twice]
        raise ValueError("; ".join(sorted(told)))
    return known.unionByName(named.select(known.columns))


def devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(DEVICES, DEVICE_SCHEMA)


def reverb_levels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REVERB, "reverb string, rt60 double, room_size double, wet double")


def environments(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ENVIRONMENTS, "profile string, noise string, snr_low double, snr_high double, events_per_minute double, room string, mic string")


def rooms(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(ROOMS, "room string, length_m double, width_m double, height_m double, rt60 double, absorption double, reflections int")


def microphones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MICROPHONES, "mic string, distortion double, noise_floor_db double, mic_rate int")


def phones(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PHONES, "phone string, low_hz int, high_hz int, rate int")


def device_parameters(device_rows: DataFrame, levels: DataFrame) -> DataFrame:
    """Augmentation parameters of each device; an unknown reverb level counts as medium."""
    known = device_rows.withColumn("reverb", F.when(F.col("reverb").isin("low", "medium", "high"), F.col("reverb")).otherwise("medium"))
    held = known.join(F.broadcast(levels), "reverb")  # three rows
    low_band = (F.col("rate") <= 8000) | (F.col("device") == "low_power")
    extra = lambda c, n: F.when(c, n).otherwise(0)
    complexity = 5 + F.col("noise_types") + extra(F.col("far_m") - F.col("near_m") > 3, 5) + extra(F.col("snr_high") - F.col("snr_low") > 20, 5)
    return held.select(
        "device",
        F.greatest(F.lit(50), "low_hz").alias("highpass_hz"),
        F.least(F.floor(F.col("rate") / 2).cast("int") - 100, F.col("high_hz")).alias("lowpass_hz"),
        (F.col("noise_floor_db") + 10).alias("self_noise_db"),
        "rt60",
        "room_size",
        "wet",
        F.when(low_band, "voip_low").alias("phone"),
        (F.col("adc_bits") < 16).alias("add_quantisation"),
        (F.col("interference_types") > 0).alias("add_interference"),
        priorities().alias("priorities"),
        F.least(F.lit(25), complexity).cast("int").alias("variations"),
    )


def priorities() -> Column:
    return F.array_compact(
        F.array(
            F.lit("microphone_simulation"),
            F.lit("noise_mixing"),
            F.when(F.col("reverb").isin("medium", "high"), "room_simulation"),
            F.when(F.col("far_m") > 3.0, "distance_simulation"),
            F.when(F.col("device").isin("mobile_ios", "mobile_android"), "telephony_simulation"),
            F.when(F.col("device").isin("esp32_pdm", "low_power"), "degradation"),
        )
    )


def prioritised(config: Column, names: Column, include_all: bool = False) -> Column:
    """Of a map of settings the active ones."""
    return config if include_all else F.map_filter(config, lambda k, _: F.array_contains(names, k))


def environment_star(spark: SparkSession) -> DataFrame:
    """Every environment with its room and microphone."""
    return environments(spark).join(F.broadcast(rooms(spark)), "room").join(F.broadcast(microphones(spark)), "mic")  # six rows each


def lookup_or_fail(requests: DataFrame, presets: DataFrame, key: str) -> DataFrame:
    """Requests with their preset; an error that lists the valid keys where one is unknown."""
    missing = [r[0] for r in requests.join(presets, key, "left_anti").select(key).distinct().limit(5).collect()]
    if missing:
        valid = sorted(r[0] for r in presets.select(key).collect())
        raise ValueError(f"unknown {key}: {missing}; valid: {valid}")
    return requests.join(presets, key)


def rule_violations(rows: DataFrame, id: str, rules: dict[str, Column]) -> DataFrame:
    """(id, violations array) of rows that break a rule; a rule whose value is null is broken."""
    told = F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]))
    return rows.select(id, told.alias("violations")).where(F.size("violations") > 0)


def room_rules() -> dict[str, Column]:
    sides = [F.col(c) > 0 for c in ("length_m", "width_m", "height_m")]
    return {"size": sides[0] & sides[1] & sides[2], "rt60": (F.col("rt60") > 0) & (F.col("rt60") <= 5), "absorption": F.col("absorption").between(0, 1), "reflections": F.col("reflections").between(1, 10)}
