"""Explicit schemas of every relation; nothing is inferred from files."""

from pyspark.sql import types as T

# ---- fixed values: audio convention and defaults ------------------------------------------
SAMPLE_RATE = 16000
SAMPLE_WIDTH = 2
HOP_LENGTH = 512
WINDOW_MS = 2000
STRIDE_MS = 250
SNRS_DB = [-5, 0, 5, 10, 15]
PAIRS_PER_SIGNAL = 2
GAIN_JITTER_DB = 6.0
N_MFCC = 13
N_FFT = 512
TEST_SIZE = 0.2
INT16_PEAK = 32767
NEGATIVE_LABEL = "background"
POSITIVE_LABEL = "bell"
# -------------------------------------------------------------------------------------------

LABEL_JSON = T.ArrayType(
    T.StructType(
        [
            T.StructField("start", T.DoubleType()),
            T.StructField("end", T.DoubleType()),
            T.StructField("labels", T.ArrayType(T.StringType())),
            T.StructField("channel", T.IntegerType()),
        ]
    )
)

LABEL_EXPORT = T.StructType(
    [
        T.StructField("annotation_id", T.LongType()),
        T.StructField("annotator", T.StringType()),
        T.StructField("audio", T.StringType()),
        T.StructField("created_at", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("label", T.StringType()),
        T.StructField("lead_time", T.DoubleType()),
        T.StructField("updated_at", T.StringType()),
    ]
)

# ids are strings: integer ids of recordings meet generated ids such as "noise_<pool>_<stem>"
ANNOTATIONS = T.StructType(
    [
        T.StructField("annotation_id", T.StringType()),
        T.StructField("file_id", T.StringType()),
        T.StructField("start", T.DoubleType()),
        T.StructField("end", T.DoubleType()),
        T.StructField("label", T.StringType()),
        T.StructField("audio_file_name", T.StringType()),
        T.StructField("remote_audio_path", T.StringType()),
    ]
)

AUGMENTED_ANNOTATIONS = T.StructType(
    ANNOTATIONS.fields
    + [
        T.StructField("snr_db", T.IntegerType()),
        T.StructField("noise_pool", T.StringType()),
        T.StructField("split_group", T.StringType()),
    ]
)

AUDIO = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rate", T.IntegerType()),
        T.StructField("frames", T.LongType()),
        T.StructField("samples", T.ArrayType(T.DoubleType())),
    ]
)

AUDIO_INFO = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("rate", T.IntegerType()),
        T.StructField("channels", T.IntegerType()),
        T.StructField("frames", T.LongType()),
        T.StructField("duration_s", T.DoubleType()),
    ]
)

CHUNK_STREAM = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("pcm", T.BinaryType()),
    ]
)

TRIGGER_STREAM = T.StructType(
    [
        T.StructField("device_id", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("source", T.StringType()),
        T.StructField("payload", T.StringType()),
    ]
)
