"""Python data sources for raw video: format("y4m") and format("rawyuv"), a row for each frame, in batch and as a stream; format("y4m") writes, too.

Frames have a fixed size, so that a file is cut into partitions by arithmetic alone and any task reads its own range.
Headers are read strictly: a y4m header without a frame rate, unknown chroma tags and truncated files fail. A headerless file has 25 frames a second unless told otherwise.
Columns that are not asked for are dropped by Spark after the read: a frame is one record and is read whole.
"""

import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

SCHEMA = "stream string, frame int, pts bigint, width int, height int, csp string, depth int, fps_num int, fps_den int, y binary, u binary, v binary"
#: Chroma tags of the format with (name, depth, horizontal and vertical subsampling).
CHROMA = {
    "420": ("420", 8, 2, 2), "420jpeg": ("420", 8, 2, 2), "420mpeg2": ("420", 8, 2, 2), "420paldv": ("420", 8, 2, 2), "422": ("422", 8, 2, 1), "444": ("444", 8, 1, 1),
    "420p10": ("420", 10, 2, 2), "422p10": ("422", 10, 2, 1), "444p10": ("444", 10, 1, 1),
}
FRAMES_PER_TASK = 32


def open_input(path: str):
    store, name = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return store.open_input_file(name)


def header(line: bytes) -> dict:
    words = line.decode("ascii").split(" ")
    if words[0] != "YUV4MPEG2":
        raise ValueError("not a YUV4MPEG2 stream")
    tags = {w[0]: w[1:] for w in words[1:] if w}
    if "F" not in tags or "W" not in tags or "H" not in tags:
        raise ValueError("width, height and frame rate are required")
    if tags.get("C", "420") not in CHROMA:
        raise ValueError(f"chroma {tags['C']} is not supported")
    num, den = map(int, tags["F"].split(":"))
    if num <= 0 or den <= 0:
        raise ValueError("the frame rate is not positive")
    return layout(int(tags["W"]), int(tags["H"]), tags.get("C", "420"), num, den)


def layout(width: int, height: int, chroma: str, num: int, den: int) -> dict:
    csp, depth, sx, sy = CHROMA[chroma]
    wide = 2 if depth > 8 else 1
    luma, side = width * height * wide, -(-width // sx) * -(-height // sy) * wide
    return {"width": width, "height": height, "csp": csp, "depth": depth, "num": num, "den": den, "luma": luma, "side": side, "size": luma + 2 * side}


def check_range(plane: bytes, depth: int) -> None:
    if depth > 8:
        import numpy as np

        if (np.frombuffer(plane, "<u2") >> depth).any():
            raise ValueError(f"a sample is over the range of {depth} bits")


class Frames(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


def cropped(plane: bytes, width: int, height: int, box: tuple[int, int, int, int], wide: int) -> bytes:
    """The samples of a plane within (left, top, width, height)."""
    import numpy as np

    x, y, w, h = box
    return np.frombuffer(plane, "<u2" if wide == 2 else "u1").reshape(height, width)[y : y + h, x : x + w].tobytes()


def deepened(plane: bytes) -> bytes:
    """Samples of 8 bits at 10 bits."""
    import numpy as np

    return (np.frombuffer(plane, "u1").astype("<u2") << 2).tobytes()


class VideoReader(DataSourceReader):
    """Options: path, and first and frames to read a part of it; crop (left,top,width,height, whole chroma samples) and depth (10 for a file of 8 bits; fewer bits are refused)."""

    def __init__(self, options: dict, raw: bool):
        self.path, self.raw, self.options = options["path"], raw, dict(options)
        with open_input(self.path) as f:
            total = f.size()
            if raw:
                self.at = 0
                self.info = layout(int(options["width"]), int(options["height"]), options.get("csp", "420"), int(options.get("fps_num", 25)), int(options.get("fps_den", 1)))
                self.skip = 0
            else:
                head = f.read(min(total, 4096))
                if b"\n" not in head:
                    raise ValueError("truncated header")
                line = head[: head.index(b"\n")]
                self.at, self.info, self.skip = len(line) + 1, header(line), 6
        step = self.skip + self.info["size"]
        if (total - self.at) % step:
            raise ValueError("truncated frame")
        count = (total - self.at) // step
        self.crop = tuple(map(int, options["crop"].split(","))) if "crop" in options else None
        if self.crop:
            x, y, w, h = self.crop
            _, _, sx, sy = CHROMA[next(k for k, v in CHROMA.items() if v[:2] == (self.info["csp"], self.info["depth"]))]
            if min(x, y) < 0 or min(w, h) < 1 or x + w > self.info["width"] or y + h > self.info["height"] or x % sx or w % sx or y % sy or h % sy:
                raise ValueError("the crop does not fit the picture and its chroma")
            self.sub = sx, sy
        self.deepen = int(options.get("depth", self.info["depth"])) - self.info["depth"]
        if self.deepen not in (0, 2):
            raise ValueError(f"samples of {self.info['depth']} bits cannot be read at {options['depth']}")
        self.first = int(options.get("first", 0))
        self.last = min(count, self.first + int(options.get("frames", count)))

    def partitions(self):
        return [Frames(i, min(self.last, i + FRAMES_PER_TASK)) for i in range(self.first, self.last, FRAMES_PER_TASK)] or [Frames(0, 0)]

    def read(self, part):
        i = self.info
        with open_input(self.path) as f:
            for n in range(part.first, part.last):
                f.seek(self.at + n * (self.skip + i["size"]))
                if self.skip and f.read(6) != b"FRAME\n":
                    raise ValueError(f"frame {n} has no marker")
                y, u, v = f.read(i["luma"]), f.read(i["side"]), f.read(i["side"])
                for plane in (y, u, v):
                    check_range(plane, i["depth"])
                width, height = i["width"], i["height"]
                if self.crop:
                    wide, (sx, sy), (left, top, w, h) = 2 if i["depth"] > 8 else 1, self.sub, self.crop
                    half = (left // sx, top // sy, w // sx, h // sy)
                    y = cropped(y, width, height, self.crop, wide)
                    u, v = (cropped(p, -(-width // sx), -(-height // sy), half, wide) for p in (u, v))
                    width, height = w, h
                if self.deepen:
                    y, u, v = map(deepened, (y, u, v))
                yield (self.path, n, n, width, height, i["csp"], i["depth"] + self.deepen, i["num"], i["den"], y, u, v)


class VideoStream(DataSourceStreamReader):
    """The frames of a file that may still grow by whole frames: an offset is a number of frames. At most `window` frames come at once, so that a reader that falls behind does not load the whole file."""

    def __init__(self, options: dict, raw: bool):
        self.options, self.raw, self.window, self.start = dict(options), raw, int(options.get("window", 256)), int(options.get("first", 0))
        self.given = self.start

    def _reader(self) -> VideoReader:
        return VideoReader({k: v for k, v in self.options.items() if k not in ("first", "frames")}, self.raw)

    def initialOffset(self):  # noqa: N802  the interface's names
        return {"frame": self.start}

    def latestOffset(self):  # noqa: N802
        self.given = max(self.given, min(self._reader().last, self.given + self.window))
        return {"frame": self.given}

    def partitions(self, start, end):
        self.given = max(self.given, end["frame"])
        return [Frames(i, min(end["frame"], i + FRAMES_PER_TASK)) for i in range(start["frame"], end["frame"], FRAMES_PER_TASK)]

    def read(self, part):
        yield from self._reader().read(part)


class Written(WriterCommitMessage):
    def __init__(self, trial: str, name: str):
        self.trial, self.name = trial, name


class VideoWriter(DataSourceWriter):
    """A folder of y4m files in frame order, one for each partition, named by its first frame. A partition's rows must be consecutive frames of one stream; its file gets its name when all are written."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def write(self, rows):
        import uuid

        store, folder = pafs.FileSystem.from_uri(self.path) if "://" in self.path else (pafs.LocalFileSystem(), self.path)
        store.create_dir(folder, recursive=True)
        trial, out, first, last, shape = f"{folder}/{uuid.uuid4().hex}.trial", None, None, None, None
        for r in rows:
            own = (r.stream, r.width, r.height, r.csp, r.depth, r.fps_num, r.fps_den)
            if out is None:
                chroma = f"{r.csp}p{r.depth}" if r.depth > 8 else r.csp
                out, first, shape = store.open_output_stream(trial), r.frame, own
                out.write(f"YUV4MPEG2 W{r.width} H{r.height} F{r.fps_num}:{r.fps_den} Ip A1:1 C{chroma}\n".encode())
            elif own != shape or r.frame != last + 1:
                raise ValueError("the frames of a partition are not consecutive frames of one stream")
            last = r.frame
            out.write(b"FRAME\n" + bytes(r.y) + bytes(r.u) + bytes(r.v))
        if out is None:
            return Written("", "")
        out.close()
        return Written(trial, f"{folder}/frames-{first:09d}.y4m")

    def _each(self, messages, act):
        store = pafs.FileSystem.from_uri(self.path)[0] if "://" in self.path else pafs.LocalFileSystem()
        for m in messages:
            if m is not None and m.trial:
                act(store, m)

    def commit(self, messages):
        self._each(messages, lambda store, m: store.move(m.trial, m.name))

    def abort(self, messages):
        self._each(messages, lambda store, m: store.delete_file(m.trial))


class Y4m(DataSource):
    @classmethod
    def name(cls):
        return "y4m"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return VideoReader(self.options, raw=False)

    def streamReader(self, schema):  # noqa: N802
        return VideoStream(self.options, raw=False)

    def writer(self, schema, overwrite):
        return VideoWriter(self.options)


class RawYuv(Y4m):
    """Needs width and height."""

    @classmethod
    def name(cls):
        return "rawyuv"

    def reader(self, schema):
        return VideoReader(self.options, raw=True)

    def streamReader(self, schema):  # noqa: N802
        return VideoStream(self.options, raw=True)

    def writer(self, schema, overwrite):
        raise ValueError("raw video is read only: it has nowhere to keep its size")


def register(spark) -> None:
    spark.dataSource.register(Y4m)
    spark.dataSource.register(RawYuv)


def luma_blocks(frames, size: int = 8):
    """stream, frame, by, bx, px ARRAY<INT>: whole blocks of the luma plane, in raster order."""
    import numpy as np
    import pyarrow as pa

    def run(parts):
        for batch in parts:
            for i in range(batch.num_rows):
                w, h, depth = (batch.column(c)[i].as_py() for c in ("width", "height", "depth"))
                y = np.frombuffer(batch.column("y")[i].as_py(), "<u2" if depth > 8 else "u1").reshape(h, w)[: h // size * size, : w // size * size]
                by, bx = y.shape[0] // size, y.shape[1] // size
                px = y.reshape(by, size, bx, size).swapaxes(1, 2).reshape(-1).astype(np.int32)
                n = by * bx
                yield pa.RecordBatch.from_arrays([
                    pa.array([batch.column("stream")[i].as_py()] * n), pa.array([batch.column("frame")[i].as_py()] * n, pa.int32()), pa.array(np.repeat(np.arange(by, dtype=np.int32), bx)),
                    pa.array(np.tile(np.arange(bx, dtype=np.int32), by)), pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * size * size), pa.array(px))], ["stream", "frame", "by", "bx", "px"])

    return frames.select("stream", "frame", "width", "height", "depth", "y").mapInArrow(run, "stream string, frame int, by int, bx int, px array<int>")
