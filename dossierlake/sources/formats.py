"""File formats by name and by content: tables of extensions and signatures, as DataFrame expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dossierlake.functions.text import contains_any, extension_of, file_name, first_match, lower_ascii

SAMPLE = 64 * 1024


def _w(words: str) -> tuple[str, ...]:
    return tuple(words.split())


# Extensions by kind, in the order in which kinds are tried.
ZIP_LIKE = _w("zip whl nupkg xpi vsix ipa aab aar egg")
JAVA_ARCHIVES = _w("jar war ear")
CODE = _w(
    "c cc cpp cxx h hh hpp hxx m mm py pyw pyi pyx pxd ipynb js mjs cjs ts mts cts tsx jsx vue svelte astro qml java kt kts "
    "groovy gvy go rs swift cs vb fs fsx fsi php rb pl pm lua r jl scala sc dart ex exs erl hrl clj cljs cljc edn hs lhs elm "
    "ml mli nim zig cr coffee pas pp f f77 f90 f95 f03 for cob cbl lisp lsp cl scm rkt tcl awk sed sh bash zsh fish ps1 psm1 "
    "bat cmd sql cmake gradle proto thrift sol move asm s v sv svh vhd vhdl tf tfvars hcl nix cue rego prisma wgsl glsl vert "
    "frag geom comp cu cuh mk mak"
)
TEXT = _w(
    "md markdown mdown mkd txt text rst adoc asc org json jsonl ndjson geojson json5 jsonc hjson yaml yml csv tsv psv xml xsd "
    "xsl xslt xaml plist html htm xhtml mhtml css scss sass less styl toml ini cfg conf config cnf env sql log diff patch "
    "editorconfig gitignore gitattributes gitmodules ignore lock properties graphql gql tex latex bib ics vcf srt vtt ass ssa "
    "po pot strings desktop service socket mount rules manifest mf spec lst list map"
)
TEXT_NAMES = _w(
    "dockerfile containerfile makefile gnumakefile gemfile rakefile procfile justfile vagrantfile brewfile license copying "
    "notice authors contributors readme changelog changes install manifest.in jenkinsfile"
)
IMAGE = _w(
    "png apng jpg jpeg jpe gif webp svg bmp dib tiff tif ico cur avif heic heif jxl jp2 j2k psd ai eps dds exr hdr icns pbm "
    "pgm ppm pnm dng raw cr2 cr3 nef arw orf rw2"
)
VIDEO = _w("mp4 mov avi mkv webm mpeg mpg m4v wmv flv mts m2ts ts vob ogv 3gp 3g2 rm rmvb asf")
AUDIO = _w("mp3 wav flac ogg oga m4a aac opus wma aiff aif alac amr ape mid midi")
MODEL = _w("onnx pt pth pkl pickle joblib safetensors tflite pb ckpt gguf ggml keras h5 caffemodel mlmodel engine trt weights pdmodel pdiparams")
SOLID = _w("glb gltf fbx obj stl dae 3ds blend usd usda usdc usdz ply 3mf step stp iges igs dwg dxf ifc skp mtl")
DATA = _w("parquet avro orc feather arrow npy npz mat hdf hdf5 sqlite sqlite3 db3 duckdb mdb accdb dbf shp shx las laz")
FONT = _w("ttf otf woff woff2 eot")
BINARY = _w("exe dll so dylib a o class wasm bin dat db dmg msi com scr appimage pyc pyo dex ko lib pdb crx")

# Types whose name isn't the kind's prefix and the extension.
OFFICE = "application/vnd.openxmlformats-officedocument."
SPECIAL = {
    "apk": "application/vnd.android.package-archive", "rar": "application/vnd.rar", "7z": "application/x-7z-compressed",
    "tar": "application/x-tar", "tgz": "application/gzip", "gz": "application/gzip", "bz2": "application/x-bzip2",
    "xz": "application/x-xz", "zst": "application/zstd", "cpio": "application/x-cpio", "ar": "application/x-archive",
    "deb": "application/vnd.debian.binary-package", "cab": "application/vnd.ms-cab-compressed", "lz4": "application/x-lz4",
    "iso": "application/x-iso9660-image", "rpm": "application/x-rpm",
    "docx": OFFICE + "wordprocessingml.document", "docm": "application/vnd.ms-word.document.macroenabled.12",
    "dotx": OFFICE + "wordprocessingml.template", "dotm": "application/vnd.ms-word.template.macroenabled.12",
    "xlsx": OFFICE + "spreadsheetml.sheet", "xlsm": "application/vnd.ms-excel.sheet.macroenabled.12",
    "xltx": OFFICE + "spreadsheetml.template", "xltm": "application/vnd.ms-excel.template.macroenabled.12",
    "xlsb": "application/vnd.ms-excel.sheet.binary.macroenabled.12", "vsdx": "application/vnd.ms-visio.drawing",
    "pptx": OFFICE + "presentationml.presentation", "pptm": "application/vnd.ms-powerpoint.presentation.macroenabled.12",
    "potx": OFFICE + "presentationml.template", "potm": "application/vnd.ms-powerpoint.template.macroenabled.12",
    "ppsx": OFFICE + "presentationml.slideshow", "ppsm": "application/vnd.ms-powerpoint.slideshow.macroenabled.12",
    "sldx": OFFICE + "presentationml.slide", "sldm": OFFICE + "presentationml.slide",
    "pdf": "application/pdf", "doc": "application/msword", "xls": "application/vnd.ms-excel", "ppt": "application/vnd.ms-powerpoint",
    "rtf": "application/rtf", "odt": "application/vnd.oasis.opendocument.text", "ott": "application/vnd.oasis.opendocument.text",
    "ods": "application/vnd.oasis.opendocument.spreadsheet", "ots": "application/vnd.oasis.opendocument.spreadsheet",
    "odp": "application/vnd.oasis.opendocument.presentation", "otp": "application/vnd.oasis.opendocument.presentation",
    "odg": "application/vnd.oasis.opendocument.graphics", "epub": "application/epub+zip", "mobi": "application/x-mobipocket-ebook",
    "fb2": "application/x-fictionbook+xml", "chm": "application/vnd.ms-htmlhelp", "azw": "application/vnd.amazon.ebook",
    "azw3": "application/vnd.amazon.ebook",
    "jpg": "image/jpeg", "jpe": "image/jpeg", "tif": "image/tiff", "svg": "image/svg+xml", "ico": "image/x-icon",
    "cur": "image/x-icon", "psd": "image/vnd.adobe.photoshop", "mpg": "video/mpeg", "mkv": "video/x-matroska",
    "mov": "video/quicktime", "3gp": "video/3gpp", "3g2": "video/3gpp2", "mp3": "audio/mpeg", "mid": "audio/midi", "aif": "audio/aiff",
    "sqlite": "application/x-sqlite3", "sqlite3": "application/x-sqlite3", "db3": "application/x-sqlite3",
    "parquet": "application/vnd.apache.parquet", "avro": "application/avro", "npy": "application/x-numpy",
    "hdf": "application/x-hdf5", "hdf5": "application/x-hdf5",
}
ARCHIVES = ZIP_LIKE + JAVA_ARCHIVES + _w("apk rar 7z tar tgz gz bz2 xz zst cpio ar deb cab lz4 iso rpm")
OFFICE_FILES = _w("docx docm dotx dotm xlsx xlsm xltx xltm xlsb pptx pptm potx potm ppsx ppsm sldx sldm vsdx")
DOCUMENTS = _w("doc xls ppt rtf odt ott ods ots odp otp odg epub mobi azw azw3 fb2 chm")
#: Kind, its extensions, and the type of those that have none of their own ({} stands for the extension).
KINDS = (
    ("archive", ZIP_LIKE, "application/zip"),
    ("archive", JAVA_ARCHIVES, "application/java-archive"),
    ("archive", ARCHIVES, "application/octet-stream"),
    ("code", CODE, "text/x-source-code"),
    ("text", TEXT, "text/plain"),
    ("office", OFFICE_FILES, ""),
    ("pdf", ("pdf",), ""),
    ("document", DOCUMENTS, ""),
    ("image", IMAGE, "image/{}"),
    ("video", VIDEO, "video/{}"),
    ("audio", AUDIO, "audio/{}"),
    ("model", MODEL, "application/x-model-artifact"),
    ("solid", SOLID, "model/{}"),
    ("binary", DATA, "application/x-data-artifact"),
    ("binary", FONT, "font/{}"),
    ("binary", BINARY, "application/octet-stream"),
)
#: Formats that aren't the extension; a name that ends in ".tar" before it makes another.
RENAMED = {"tgz": "tar.gz", "gz": "gzip", "bz2": "bzip2", "zst": "zstd"}


def extension_rows() -> list[tuple[str, str, str, str, str]]:
    """(extension, kind, format, mime, language); an extension has the first kind that lists it."""
    rows: dict[str, tuple[str, str, str, str, str]] = {}
    for kind, extensions, mime in KINDS:
        for e in extensions:
            special = "" if kind in ("code", "text") else SPECIAL.get(e, "")
            language = e if kind == "code" else ""
            rows.setdefault(e, ("." + e, kind, RENAMED.get(e, e), special or mime.format(e), language))
    return list(rows.values())


def extension_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(extension_rows(), "extension string, kind string, format string, mime string, language string")


def with_format(files: DataFrame) -> DataFrame:
    """Add file_name, extension, kind, format, mime, language by the path alone. The table has a few hundred rows."""
    name, low = file_name(F.col("path")), lower_ascii(file_name(F.col("path")))
    plain = files.withColumn("file_name", name).withColumn("extension", extension_of(F.col("path")))
    known = plain.join(F.broadcast(extension_table(files.sparkSession)), "extension", "left")
    tar = F.regexp_extract(low, r"\.tar\.(gz|bz2|xz|zst)$", 1)
    named = F.col("kind").isNull() & low.isin(*TEXT_NAMES)
    bare = F.substring(F.col("extension"), 2, 1000)
    return (
        known.withColumn(
            "format",
            first_match(
                [(tar != "", F.concat(F.lit("tar."), tar)), (F.col("format").isNotNull(), F.col("format")), (bare != "", bare), (named, "text")],
                "unknown",
            ),
        )
        .withColumn("mime", first_match([(F.col("mime").isNotNull(), F.col("mime")), (named, "text/plain")], "application/octet-stream"))
        .withColumn("kind", first_match([(F.col("kind").isNotNull(), F.col("kind")), (named, "text")], "unknown"))
        .withColumn("language", F.coalesce("language", F.lit("")))
    )


# Fixed values: (offset, bytes in hex), format, kind, type; the first whose bytes are all there counts.
SIGNATURES: tuple[tuple[tuple[tuple[int, str], ...], str, str, str], ...] = (
    (((0, "255044462D"),), "pdf", "pdf", "application/pdf"),
    (((0, "504B0304"),), "zip", "archive", "application/zip"),
    (((0, "504B0506"),), "zip", "archive", "application/zip"),
    (((0, "504B0708"),), "zip", "archive", "application/zip"),
    (((0, "89504E470D0A1A0A"),), "png", "image", "image/png"),
    (((0, "FFD8FF"),), "jpeg", "image", "image/jpeg"),
    (((0, "47494638"),), "gif", "image", "image/gif"),
    (((0, "52494646"), (8, "57454250")), "webp", "image", "image/webp"),
    (((0, "424D"),), "bmp", "image", "image/bmp"),
    (((0, "49492A00"),), "tiff", "image", "image/tiff"),
    (((0, "4D4D002A"),), "tiff", "image", "image/tiff"),
    (((0, "00000100"),), "ico", "image", "image/x-icon"),
    (((0, "38425053"),), "psd", "image", "image/vnd.adobe.photoshop"),
    (((0, "0000000C6A5020200D0A870A"),), "jp2", "image", "image/jp2"),
    (((0, "44445320"),), "dds", "image", "image/vnd-ms.dds"),
    (((0, "762F3101"),), "exr", "image", "image/x-exr"),
    (((0, "52494646"), (8, "57415645")), "wav", "audio", "audio/wav"),
    (((0, "4F676753"),), "ogg", "audio", "audio/ogg"),
    (((0, "664C6143"),), "flac", "audio", "audio/flac"),
    (((0, "494433"),), "mp3", "audio", "audio/mpeg"),
    (((0, "FF[EF]."),), "mp3", "audio", "audio/mpeg"),
    (((0, "464F524D"), (8, "4149464[36]")), "aiff", "audio", "audio/aiff"),
    (((0, "4D546864"),), "midi", "audio", "audio/midi"),
    (((0, "52494646"), (8, "41564920")), "avi", "video", "video/x-msvideo"),
    (((0, "464C56"),), "flv", "video", "video/x-flv"),
    (((0, "1A45DFA3"),), "mkv", "video", "video/x-matroska"),
    (((4, "66747970"), (8, "617669(66|73)")), "avif", "image", "image/avif"),
    (((4, "66747970"), (8, "(68656963|68656978|6D696631)")), "heic", "image", "image/heic"),
    (((4, "66747970"), (8, "6A786C20")), "jxl", "image", "image/jxl"),
    (((4, "66747970"),), "mp4", "video", "video/mp4"),
    (((0, "676C5446"),), "glb", "solid", "model/gltf-binary"),
    (((0, "424C454E444552"),), "blend", "solid", "model/vnd.blender"),
    (((4, "54464C33"),), "tflite", "model", "application/x-model-artifact"),
    (((0, "1F8B"),), "gzip", "archive", "application/gzip"),
    (((0, "377ABCAF271C"),), "7z", "archive", "application/x-7z-compressed"),
    (((0, "28B52FFD"),), "zstd", "archive", "application/zstd"),
    (((0, "FD377A585A00"),), "xz", "archive", "application/x-xz"),
    (((0, "425A683[1-9]"),), "bzip2", "archive", "application/x-bzip2"),
    (((0, "526172211A07(00|0100)"),), "rar", "archive", "application/vnd.rar"),
    (((257, "7573746172(00|20)"),), "tar", "archive", "application/x-tar"),
    (((0, "213C617263683E0A"),), "ar", "archive", "application/x-archive"),
    (((0, "4D534346"),), "cab", "archive", "application/vnd.ms-cab-compressed"),
    (((0, "04224D18"),), "lz4", "archive", "application/x-lz4"),
    (((0x8001, "4344303031"),), "iso", "archive", "application/x-iso9660-image"),
    (((0, "7B5C727466"),), "rtf", "document", "application/rtf"),
    (((0, "D0CF11E0A1B11AE1"),), "ole", "document", "application/x-ole-storage"),
    (((0, "53514C69746520666F726D6174203300"),), "sqlite", "binary", "application/x-sqlite3"),
    (((0, "7F454C46"),), "elf", "binary", "application/x-executable"),
    (((0, "4D5A"),), "pe", "binary", "application/x-executable"),
    (((0, "(FEEDFACE|CEFAEDFE|FEEDFACF|CFFAEDFE)"),), "mach-o", "binary", "application/x-mach-binary"),
    (((0, "0061736D"),), "wasm", "binary", "application/wasm"),
    (((0, "CAFEBABE"),), "class", "binary", "application/java-vm"),
    (((0, "6465780A"),), "dex", "binary", "application/vnd.android.dex"),
    (((0, "894844460D0A1A0A"),), "hdf5", "binary", "application/x-hdf5"),
    (((0, "934E554D5059"),), "npy", "binary", "application/x-numpy"),
    (((0, "50415231"),), "parquet", "binary", "application/vnd.apache.parquet"),
    (((0, "4F626A01"),), "avro", "binary", "application/avro"),
    (((0, "47475546"),), "gguf", "model", "application/x-model-artifact"),
    (((0, "62706C6973743030"),), "binary-plist", "binary", "application/x-plist"),
    (((0, "00010000"),), "ttf", "binary", "font/ttf"),
    (((0, "4F54544F"),), "otf", "binary", "font/otf"),
    (((0, "774F4646"),), "woff", "binary", "font/woff"),
    (((0, "774F4632"),), "woff2", "binary", "font/woff2"),
)
# What a ZIP container's names tell, the first that is there counting.
ZIP_CONTENT = (
    ("word/", "docx", "office", OFFICE + "wordprocessingml.document"),
    ("ppt/", "pptx", "office", OFFICE + "presentationml.presentation"),
    ("xl/", "xlsx", "office", OFFICE + "spreadsheetml.sheet"),
    ("application/epub+zip", "epub", "document", "application/epub+zip"),
    ("application/vnd.oasis.opendocument.text", "odt", "document", "application/vnd.oasis.opendocument.text"),
    ("application/vnd.oasis.opendocument.spreadsheet", "ods", "document", "application/vnd.oasis.opendocument.spreadsheet"),
    ("application/vnd.oasis.opendocument.presentation", "odp", "document", "application/vnd.oasis.opendocument.presentation"),
    ("AndroidManifest.xml", "apk", "archive", "application/vnd.android.package-archive"),
)


def signature(content: Column) -> Column:
    """struct(format, kind, mime) of the first signature that the content has, or null."""
    sample = F.substring(content, 1, SAMPLE)
    value = lambda f, k, m: F.struct(F.lit(f).alias("format"), F.lit(k).alias("kind"), F.lit(m).alias("mime"))
    has = lambda text: F.instr(F.decode(sample, "ISO-8859-1"), text) > 0
    cases: list[tuple[Column, object]] = []
    for parts, name, kind, mime in SIGNATURES:
        test = F.lit(True)
        for offset, pattern in parts:
            # the offsets are few, so their hexadecimal heads are computed once each
            test = test & F.hex(F.substring(sample, offset + 1, 16)).rlike("^" + pattern)
        if name == "zip":
            cases += [(test & has(mark), value(f, k, m)) for mark, f, k, m in ZIP_CONTENT]
        if name == "mkv":
            cases.append((test & has("webm"), value("webm", "video", "video/webm")))
        cases.append((test, value(name, kind, mime)))
    return first_match(cases, F.lit(None).cast("struct<format:string,kind:string,mime:string>"))


def looks_like_text(content: Column, magic: Column) -> Column:
    """Empty, or valid UTF-8 without a signature or NUL and with at most one control byte in a hundred.

    Where the sample ends within a character, the character's other bytes, three at most, are looked at too.
    """
    sample = F.substring(content, 1, SAMPLE)
    whole = reduce(lambda a, b: a | b, (F.is_valid_utf8(F.substring(content, 1, SAMPLE + more).cast("string")) for more in range(4)))
    text = F.decode(sample, "ISO-8859-1")
    controls = F.length(text) - F.length(F.regexp_replace(text, r"[\x00-\x08\x0B\x0E-\x1F]", ""))
    plain = whole & ~text.contains("\0") & (controls * 100 <= F.length(text))
    return (F.octet_length(sample) == 0) | (magic.isNull() & plain)


def detect_formats(files: DataFrame, strings: Column | None = None) -> DataFrame:
    """Reconcile names with content: path, size_bytes, content in; format, mime, auditable and risk_flags added.

    ``strings``: true of files whose content was a string before it became a file, so it is text whatever bytes it has.
    """
    known = with_format(files).withColumn("__m", signature(F.col("content")))
    told = F.lit(False) if strings is None else F.coalesce(strings, F.lit(False))
    known = known.withColumn("__t", told | looks_like_text(F.col("content"), F.col("__m")))
    kind, magic, text = F.col("kind"), F.col("__m"), F.col("__t")
    zipped = F.hex(F.substring("content", 1, 4)).isin("504B0304", "504B0506", "504B0708")
    has, other = magic.isNotNull(), lambda *kinds: magic["kind"].isin(*kinds)
    media = kind.isin("audio", "video") & other("audio", "video")
    found = first_match([(has, magic["format"]), (text, F.lit("text"))], "binary")
    found_mime = first_match([(has, magic["mime"]), (text, F.lit("text/plain"))], "application/octet-stream")
    mismatch = first_match(
        [
            (kind.isin("code", "text"), ~text),
            (kind == "office", ~zipped),
            (kind == "pdf", ~F.coalesce(magic["kind"] == "pdf", F.lit(False))),
            (kind == "archive", (has & ~other("archive", "office", "document")) | (~has & text & ~zipped)),
            (kind == "image", (has & ~other("image")) | (~has & text & (F.col("extension") != ".svg"))),
            (
                kind != "unknown",
                (has & (magic["kind"] != kind) & ~media & ~kind.isin("document", "model")) | ((kind == "binary") & ~has & text),
            ),
        ],
        False,
    )
    mismatch = F.coalesce(mismatch, F.lit(False))
    unknown = kind == "unknown"
    flags = F.array_compact(
        F.array(
            F.when(mismatch, F.lit("EXTENSION_CONTENT_MISMATCH")),
            F.when(unknown & has, F.lit("CONTENT_FORMAT_DETECTED")),
            F.when(unknown & ~has & text, F.lit("UNKNOWN_TEXT_EXTENSION")),
            F.when(unknown & ~has & ~text, F.lit("UNRECOGNIZED_BINARY_FORMAT")),
        )
    )
    bare = F.col("extension") == ""
    audible = first_match(
        [(kind.isin("code", "text", "office", "pdf"), ~mismatch), (unknown & has, other("pdf", "office")), (unknown, text)], False
    )
    new_format = first_match(
        [(mismatch | (unknown & has), found), (unknown & bare & text, "text"), (unknown & bare, "binary")], F.col("format")
    )
    new_mime = first_match([(mismatch | unknown, found_mime)], F.col("mime"))
    return (
        known.withColumn("auditable", F.coalesce(audible, F.lit(False)))
        .withColumn("risk_flags", flags)
        .withColumn("__f", new_format)
        .withColumn("mime", new_mime)
        .withColumn("format", F.col("__f"))
        .drop("__m", "__t", "__f")
    )


def is_archive_path(path: Column) -> Column:
    return extension_of(path).isin(*["." + e for e in ARCHIVES])


def contains_mark(text: Column, marks: tuple[str, ...]) -> Column:
    return contains_any(lower_ascii(text), marks)
