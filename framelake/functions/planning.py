"""Planning rules as Column expressions: a batch of requests is validated and planned as rows, and an error is a value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from framelake.functions import columns as C

# Fixed values of the interface.
PROTOCOLS = ("file", "http", "https", "tcp", "tls", "crypto")
HDR_TRANSFERS = ("smpte2084", "arib-std-b67")
HDR_PRIMARIES = "bt2020"
UNSET_COLOR = ("unknown", "unspecified")
MAX_BYTES = 16 << 30
TONE_MAP_CHAIN = "zscale=t=linear:npl=100,format=gbrpf32le,tonemap=hable:desat=0,zscale=p=bt709:t=bt709:m=bt709:range=tv"
LAYOUTS = ("mono", "stereo", "2.1", "4.0", "5.0", "5.1", "6.1", "7.1")
LOUDNESS_OPTIONS = ("I", "LRA", "TP", "measured_I", "measured_LRA", "measured_TP", "measured_thresh", "offset", "linear", "dual_mono")


def route(uri: Column) -> Column:
    """Which scanner reads a uri; the prefix is case-sensitive."""
    return F.when(uri.startswith("gs://"), "gcs").when(uri.startswith("s3://"), "s3").otherwise("file")


def scheme(uri: Column) -> Column:
    """The protocol that would open a uri: the name before its first colon, without what is nested after a plus; 'file' if there is none. One protocol has options between its name and the colon."""
    name = F.regexp_extract(uri, "^([A-Za-z0-9.-]+)(?:\\+[A-Za-z0-9+.-]*)?:", 1)
    return F.when(uri.rlike("^subfile,[^:]*:"), "subfile").when(name == "", "file").otherwise(name)


def allowed(uri: Column) -> Column:
    """Whether a uri may be opened: by its protocol, and for one that opens another uri itself (crypto), by that one's."""
    own = scheme(uri).isin(*PROTOCOLS)
    rest = F.regexp_replace(uri, "^(?:crypto[+:])+", "")
    return own & scheme(rest).isin(*PROTOCOLS)


def bucket(uri: Column) -> Column:
    """Of gs:// in the form of its service, of s3:// as it is; null for others."""
    host = F.regexp_extract(uri, "^(?:gs|s3)://([^/]*)", 1)
    return F.when(host == "", None).when(uri.startswith("gs://"), F.concat(F.lit("projects/_/buckets/"), host)).otherwise(host)


def object_key(uri: Column) -> Column:
    return F.when(bucket(uri).isNotNull(), F.regexp_extract(uri, "^(?:gs|s3)://[^/]*/?(.*)$", 1))


def uri_status(uri: Column) -> Column:
    """'ok', or what is wrong: an object store's uri needs a bucket, and s3:// a key as well."""
    stored = uri.startswith("gs://") | uri.startswith("s3://")
    return F.when(stored & bucket(uri).isNull(), "no bucket").when(uri.startswith("s3://") & (object_key(uri) == ""), "no key").otherwise("ok")


def credentials(key_id: Column, secret: Column, token: Column, mode: Column) -> Column:
    """'static', 'default', 'container', or 'error: ...'. Arguments: strings or null."""
    pair = key_id.isNotNull() & secret.isNotNull()
    return (
        F.when(key_id.isNotNull() != secret.isNotNull(), "error: id and secret go together")
        .when(token.isNotNull() & ~pair, "error: a token needs id and secret")
        .when(pair & mode.isNotNull(), "error: static credentials or a mode")
        .when(pair, "static")
        .when(mode.isNull() | (mode == "default"), "default")
        .when(mode == "container", "container")
        .otherwise("error: unknown mode")
    )


def window_status(duration: Column, start: Column, end: Column) -> Column:
    return F.when(duration.isNull(), "unknown duration").when(start.isNotNull() & end.isNotNull() & (end <= start), "empty window").when(start.isNotNull() & end.isNull() & (duration <= start), "start after end").otherwise("ok")


def effective_duration(duration: Column, start: Column, end: Column) -> Column:
    """Seconds that a window of a stream covers; null where the window isn't valid."""
    seconds = F.when(start.isNotNull() & end.isNotNull(), C.least(duration, end - start)).when(end.isNotNull(), C.least(duration, end)).when(start.isNotNull(), duration - start).otherwise(duration)
    return F.when(window_status(duration, start, end) == "ok", seconds)


def frame_rate(requested: Column, guessed: Column, n_frames: Column, duration: Column) -> Column:
    """As requested, else as told by the container, else by counting; null if none is known."""
    return F.coalesce(requested, F.when(guessed > 0, guessed), F.when((n_frames > 0) & (duration > 0), n_frames / duration))


def frame_capacity(seconds: Column, fps: Column) -> Column:
    """Rows of a video result: half a frame less keeps a phantom last one out."""
    return F.ceil((seconds - F.lit(0.5) / fps) * fps).cast("long")


def sample_capacity(seconds: Column, rate: Column) -> Column:
    return F.when((seconds >= 0) & (rate > 0), F.ceil(seconds * rate).cast("long"))


def tensor_bytes(dims: list[Column], element: Column) -> Column:
    """As decimal, so that it can't overflow; null for a negative size."""
    product = element.cast("decimal(38,0)")
    for d in dims:
        product = (product * d.cast("decimal(12,0)")).cast("decimal(38,0)")
    bad = dims[0] < 0
    for d in dims[1:]:
        bad = bad | (d < 0)
    return F.when(~bad, product)


def hardware_size(width: Column, height: Column, to_width: Column, to_height: Column) -> tuple[Column, Column]:
    """Size of a decoder's own scaling: one side given keeps the aspect, sides are even and 2 at least; null unless both shrink."""
    given = to_width.isNotNull() | to_height.isNotNull()
    w = F.coalesce(to_width.cast("long"), C.idiv(width * to_height * 2 + height, height * 2))
    h = F.coalesce(to_height.cast("long"), C.idiv(height * to_width * 2 + width, width * 2))
    w, h = (F.greatest(F.lit(2).cast("long"), x.bitwiseAND(F.lit(-2).cast("long"))) for x in (w, h))
    shrinks = given & (width > 0) & (height > 0) & (w < width) & (h < height)
    return F.when(shrinks, w), F.when(shrinks, h)


def device_index(device: Column) -> Column:
    """Of 'cuda' 0, of 'cuda:N' N; -1 for anything else, null for null."""
    n = F.regexp_extract(device, "^cuda:([0-9]{1,9})$", 1)
    return F.when(device.isNull(), None).when(device == "cuda", 0).when(n != "", n.try_cast("int")).otherwise(-1).cast("int")


def device_status(hardware: Column, fps: Column, dtype: Column, width: Column, height: Column, to_width: Column, to_height: Column) -> Column:
    """What forbids decoding on a device: the first reason in this order, or 'ok'."""
    return (
        F.when(hardware == F.lit(False), "device cannot be combined with hardware_acceleration=false")
        .when(fps.isNotNull(), "fps is not supported on a device")
        .when(dtype != "uint8", "dtype must be uint8")
        .when(to_width.isNull() != to_height.isNull(), "give both sides or none")
        .when((to_width % 2 != 0) | (to_height % 2 != 0), "sides must be even")
        .when((to_width >= width) | (to_height >= height), "only downscaling")
        .otherwise("ok")
    )


def color_tag(name: Column) -> Column:
    return F.when(~name.isin(*UNSET_COLOR), name)


def is_hdr(transfer: Column, primaries: Column) -> Column:
    """By either tag; an unset one says nothing."""
    return F.coalesce(color_tag(transfer).isin(*HDR_TRANSFERS), F.lit(False)) | F.coalesce(color_tag(primaries) == HDR_PRIMARIES, F.lit(False))


def direct_path(fps: Column, width: Column, height: Column, hdr: Column, dtype: Column, target_width: Column) -> Column:
    """Whether frames need a change of format alone."""
    return fps.isNull() & width.isNull() & height.isNull() & ~hdr & (dtype == "uint8") & (target_width % 32 == 0)


def video_spec(fps: Column, width: Column, height: Column, hdr: Column, dtype: Column) -> Column:
    scale = F.when(width.isNotNull() | height.isNotNull(), F.concat(F.lit("scale="), F.concat_ws(":", F.concat(F.lit("width="), width.cast("string")), F.concat(F.lit("height="), height.cast("string")))))
    pixel = F.when(dtype == "float32", "format=pix_fmts=gbrpf32le").otherwise("format=pix_fmts=rgb24")
    return F.concat_ws(",", F.concat(F.lit("fps="), C.plain(fps)), scale, F.when(hdr, TONE_MAP_CHAIN), pixel)


def loudness_spec(options: dict[str, Column]) -> Column:
    """Only options that are set, in their fixed order."""
    parts = [F.concat(F.lit(f"{k}="), options[k].cast("string") if k in ("linear", "dual_mono") else C.plain(options[k])) for k in LOUDNESS_OPTIONS if k in options]
    return F.concat(F.lit("loudnorm="), F.concat_ws(":", *parts))


def audio_spec(loudness: Column, rate: Column) -> Column:
    spec = F.concat_ws(",", loudness, F.concat(F.lit("aresample="), rate.cast("string")))
    return F.when(spec == "", "anull").otherwise(spec)


def channel_layout(channels: Column) -> Column:
    """The default layout of a number of channels, where a stream tells none; null where there is none."""
    return F.when(channels.between(1, len(LAYOUTS)), F.element_at(F.array(*map(F.lit, LAYOUTS)), channels.cast("int")))
