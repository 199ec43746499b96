"""Column expressions on sizes, times, tiers, versions, paths, references and texts.  All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: File categories by extension; anything else is ``binary``.
KINDS = {
    "video": "mp4 m4v mov mkv avi webm wmv flv mxf r3d braw ari dpx exr prores 3gp 3g2 m2ts mts vob ogv",
    "audio": "mp3 wav aiff aif flac aac m4a ogg wma opus alac",
    "image": "psd psb tiff tif raw cr2 cr3 nef arw dng orf rw2 png jpg jpeg gif bmp webp heic heif avif",
    "model3d": "blend blend1 ma mb max c4d hip hiplc fbx obj dae gltf glb usd usda usdc usdz abc 3ds stl ply",
    "project": "prproj drp aep nk hrox veg fcpxml xml otio edl aaf omf",
    "game_asset": "uasset umap prefab unity asset mat controller anim meta",
    "archive": "zip rar 7z tar gz bz2 xz lz4 zst pak pkg",
    "text": "txt md json yaml yml toml ini cfg rs py js ts jsx tsx html css c cpp h hpp java kt swift go sh bash zsh ps1 bat cmd",
}
#: Categories that want a lock, and those whose files can be merged line by line.
LOCKED, MERGEABLE = ("project", "model3d", "game_asset"), ("text", "project")
#: Extensions of files stored as text.
TEXT_EXTENSIONS = (
    "txt md markdown rst adoc asciidoc org tex rtf json yaml yml toml xml csv tsv ini cfg conf properties env html htm xhtml css scss sass less styl svg "
    "js mjs cjs jsx ts tsx mts cts vue svelte astro rs go c cpp cc cxx h hpp hxx hh zig nim v d py pyi pyw rb rbw pl pm t php php3 php4 php5 phtml lua tcl r rmd jl "
    "sh bash zsh fish ksh csh tcsh ps1 psm1 psd1 bat cmd java kt kts scala sc groovy gradle clj cljs cljc edn cs csx fs fsx fsi vb vbs cshtml razor "
    "hs lhs ml mli elm ex exs erl hrl sql psql mysql pgsql graphql gql proto protobuf thrift avsc avro fbs makefile cmake mak mk ninja dockerfile containerfile "
    "vagrantfile rakefile gemfile podfile cartfile fastfile procfile lock gitignore gitattributes gitmodules mailmap editorconfig prettierrc eslintrc stylelintrc "
    "babelrc swcrc browserslistrc tf tfvars hcl nomad sentinel workflow action license licence copying authors contributors changelog history news readme todo fixme hack"
).split()
#: Extensions of files stored as binary, beside those of the video, audio, image, model3d, game_asset and archive categories.
BINARY_EXTENSIONS = (
    "m2v mpg mpeg oga ape wv mka ac3 dts mid midi ico icns jxl pef srw raf ai eps indd sketch fig xd xcf kra cdr afdesign afphoto afpub hipnc nk nknc "
    "lz lzma cab arj lzh ace iso dmg deb rpm apk ipa msi appx snap flatpak exe dll so dylib a lib o ko sys drv efi elf bin com app bundle "
    "pdf doc docx xls xlsx ppt pptx odt ods odp odg pages numbers key epub mobi azw azw3 djvu ttf otf woff woff2 eot pfb pfm fon fnt "
    "db sqlite sqlite3 mdb accdb frm myd myi ibd dbf upk wad bsp vpk gcf der p12 pfx jks keystore"
).split()
#: Extensions of files stored as both.
HYBRID_EXTENSIONS = "prproj aep drp fcpxml otio".split()
#: Whole names of files stored as text, where the extension says nothing.
TEXT_NAMES = (
    ".bashrc .bash_profile .bash_logout .zshrc .zprofile .zshenv .profile .login .logout .vimrc .gvimrc .exrc .nanorc .emacs .spacemacs .gitconfig .gitignore "
    ".gitattributes .npmrc .yarnrc .nvmrc .python-version .ruby-version .node-version .tool-versions .htpasswd .htaccess .htgroups .dockerignore go.mod go.sum "
    "gemfile pipfile .circleci jenkinsfile"
).split()
#: MIME types by extension.
MIME = {
    "mp4": "video/mp4", "m4v": "video/mp4", "mov": "video/quicktime", "avi": "video/x-msvideo", "mkv": "video/x-matroska", "webm": "video/webm", "wmv": "video/x-ms-wmv",
    "flv": "video/x-flv", "mxf": "application/mxf", "3gp": "video/3gpp", "mp3": "audio/mpeg", "wav": "audio/wav", "flac": "audio/flac", "aac": "audio/aac", "ogg": "audio/ogg",
    "m4a": "audio/mp4", "wma": "audio/x-ms-wma", "jpg": "image/jpeg", "jpeg": "image/jpeg", "png": "image/png", "gif": "image/gif", "webp": "image/webp", "bmp": "image/bmp",
    "tiff": "image/tiff", "tif": "image/tiff", "svg": "image/svg+xml", "ico": "image/x-icon", "heic": "image/heic", "heif": "image/heic", "cr2": "image/x-canon-cr2",
    "cr3": "image/x-canon-cr3", "nef": "image/x-nikon-nef", "arw": "image/x-sony-arw", "dng": "image/x-adobe-dng", "raf": "image/x-fuji-raf", "rw2": "image/x-panasonic-rw2",
    "orf": "image/x-olympus-orf", "pdf": "application/pdf", "doc": "application/msword", "docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    "xls": "application/vnd.ms-excel", "xlsx": "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet", "ppt": "application/vnd.ms-powerpoint",
    "pptx": "application/vnd.openxmlformats-officedocument.presentationml.presentation", "prproj": "application/x-premiere-project", "aep": "application/x-aftereffects-project",
    "drp": "application/x-davinci-resolve-project", "fcpxml": "application/x-finalcut-project", "txt": "text/plain", "md": "text/markdown", "json": "application/json",
    "xml": "application/xml", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript",
}


def choose(c: Column, values: dict[str, str], default: str | None = None) -> Column:
    """A value for a key (constant folding makes it a hash lookup over literals)."""
    table = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])
    return F.coalesce(F.element_at(table, c), F.lit(default))


def extension(path: Column) -> Column:
    """The lower-case extension of the last name, empty if there is none (a leading dot is none)."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def stem(path: Column) -> Column:
    """The last name without its extension."""
    return F.regexp_replace(F.substring_index(path, "/", -1), r"(.)\.[^.]*$", "$1")


def parent(path: Column) -> Column:
    """The folder of a path, empty at the top."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_kind(path: Column) -> Column:
    """The category of a file by its extension."""
    return choose(extension(path), {e: k for k, es in KINDS.items() for e in es.split()}, "binary")


def storage_by_name(path: Column) -> Column:
    """``text``, ``binary`` or ``hybrid`` by extension or whole name; null where these say nothing."""
    by = {e: "binary" for k in ("video", "audio", "image", "model3d", "game_asset", "archive") for e in KINDS[k].split()}
    by.pop("meta")  # stored by its content
    by |= dict.fromkeys(BINARY_EXTENSIONS, "binary") | dict.fromkeys(TEXT_EXTENSIONS, "text") | dict.fromkeys(HYBRID_EXTENSIONS, "hybrid")
    return F.coalesce(choose(extension(path), by), choose(F.lower(F.substring_index(path, "/", -1)), dict.fromkeys(TEXT_NAMES, "text")))


def storage_of(path: Column, data: Column) -> Column:
    """How a file is stored: by its name, else by its content (binary): empty means text, a NUL in the first 8 KiB or
    bytes that are not UTF-8 mean binary, lines of less than 500 bytes on average text; unknown content means binary."""
    content = data.cast("binary")
    text = data.cast("string")
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + F.when(F.endswith(text, F.lit("\n")), 0).otherwise(1)
    ends = F.size(F.regexp_extract_all(text, F.lit(r"(\r?\n)"))) + F.size(F.regexp_extract_all(text, F.lit(r"(\r\n)")))
    mean = F.floor((F.octet_length(content) - ends) / F.greatest(lines, F.lit(1)))
    looks = (
        F.when(content.isNull(), "binary")
        .when(F.octet_length(content) == 0, "text")
        .when(F.contains(F.substring(content, 1, 8192), F.unhex(F.lit("00"))), "binary")
        .when(F.is_valid_utf8(content.cast("string")) & (mean < 500), "text")
        .otherwise("binary")
    )
    return F.coalesce(storage_by_name(path), looks)


def mime_type(path: Column) -> Column:
    """The MIME type by extension."""
    return choose(extension(path), MIME, "application/octet-stream")


def content_type(mime: Column) -> Column:
    """video, audio, photo, text, project or file, by the MIME type."""
    out = F.when(mime.contains("project"), "project").otherwise("file")
    for prefix, name in (("text/", "text"), ("image/", "photo"), ("audio/", "audio"), ("video/", "video")):
        out = F.when(mime.startswith(prefix), name).otherwise(out)
    return out


def short_hash(h: Column, n: int = 8) -> Column:
    return F.substring(h, 1, n)


def fan_out(h: Column) -> Column:
    """The path of an object: two digits, then the rest."""
    return F.concat_ws("/", F.substring(h, 1, 2), F.substring(h, 3, 1 << 10))


def format_bytes(n: Column) -> Column:
    """``512 B``, ``1.50 KB`` ... with powers of 1024 and two digits."""
    out = F.format_string("%d B", n)
    for k, unit in enumerate(("KB", "MB", "GB", "TB"), 1):
        out = F.when(n >= 1024**k, F.format_string(f"%.2f {unit}", n / float(1024**k))).otherwise(out)
    return out


def parse_bytes(text: Column) -> Column:
    """Bytes of ``1.5GB``, ``10 kb``, ``7``; null for anything else.  Fractions are cut off."""
    number = F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)i?b?\s*$", 1)
    unit = F.upper(F.regexp_extract(text, r"(?i)^\s*([0-9]+(?:\.[0-9]+)?)\s*([kmgt]?)i?b?\s*$", 2))
    factor = F.when(unit == "K", 1024).when(unit == "M", 1024**2).when(unit == "G", 1024**3).when(unit == "T", 1024**4).otherwise(1)
    return F.when(number != "", F.floor(F.try_to_number(number, F.lit("999999999999.999")).cast("double") * factor).cast("long"))


def percentage(part: Column, whole: Column) -> Column:
    """100 if there is nothing to do."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(100.0))


def eta_seconds(left: Column, speed: Column) -> Column:
    return F.floor(F.try_divide(left, speed)).cast("long")


def remaining(expires: Column, as_of: Column) -> Column:
    """``2h 5m``, ``7m``, ``9s`` or ``expired``."""
    s = F.unix_timestamp(expires.cast("timestamp")) - F.unix_timestamp(as_of.cast("timestamp"))
    hours, minutes = F.floor(s / 3600).cast("long"), F.floor(F.pmod(s, F.lit(3600)) / 60).cast("long")
    return F.when(s <= 0, "expired").when(s >= 3600, F.format_string("%dh %dm", hours, minutes)).when(s >= 60, F.format_string("%dm", minutes)).otherwise(F.format_string("%ds", s))


def version_key(name: Column) -> Column:
    """The numbers in a version, for sorting: arrays compare number by number, the shorter first."""
    return F.transform(F.regexp_extract_all(name, F.lit(r"(\d+)")), lambda x: x.cast("long"))


def remote_kind(url: Column) -> Column:
    """``http``, ``ssh`` or ``local``."""
    return F.when(F.lower(url).rlike("^https?://"), "http").when(F.lower(url).rlike("^ssh://") | url.rlike(r"^[^/@:]+@[^/:]+:"), "ssh").otherwise("local")


def revision(text: Column) -> Column:
    """struct(base, steps) of ``name~N``, ``name^`` and ``name^N``: how many first parents to walk back."""
    base, mark, n = (F.regexp_extract(text, r"^([^~^]+)([~^]?)(\d*)$", k) for k in (1, 2, 3))
    return F.struct(base.alias("base"), F.when(mark == "", 0).when(n == "", 1).otherwise(n.try_cast("int")).alias("steps"))


def mode_bits(mode: Column) -> Column:
    return choose(mode, {"regular": "644", "executable": "755", "symlink": "777"})


def shifted_offsets(offsets: Column, delta: Column, limit: int = (1 << 32) - 1) -> Column:
    """Sample table positions moved by ``delta``; raises where one leaves 0..limit."""
    moved = F.transform(offsets, lambda o: o + delta)
    bad = F.exists(moved, lambda o: (o < 0) | (o > limit))
    return F.when(bad, F.raise_error(F.lit("offset out of range")).cast("array<bigint>")).otherwise(moved)


def chunk_size_for(mbps: Column, latency_ms: Column) -> Column:
    """Mean chunk size in bytes for a link: 8 MiB above a gigabit, 2 MiB above 100 megabits, else 1 MiB below 50 ms, else 256 KiB."""
    return F.when(mbps > 1000, 8 << 20).when(mbps > 100, 2 << 20).when(latency_ms < 50, 1 << 20).otherwise(256 << 10)


def chunk_bounds(mean: Column) -> Column:
    """struct(least, most) around a mean chunk size: a quarter, but 64 KiB, and four times it, but 32 MiB."""
    return F.struct(F.greatest(F.floor(mean / 4).cast("long"), F.lit(64 << 10)).alias("least"), F.least((mean * 4).cast("long"), F.lit(32 << 20)).alias("most"))


def bloom_parameters(n: Column, p: float) -> Column:
    """struct(bytes, hashes) of a Bloom filter for n keys and a false positive rate p."""
    import math

    bits = F.ceil(n * (-math.log(p) / math.log(2) ** 2))
    size = F.ceil(bits / 8)
    return F.struct(size.cast("long").alias("bytes"), F.greatest(F.lit(1), F.least(F.lit(16), F.round(size * 8 / n * math.log(2)).cast("int"))).alias("hashes"))


def term_score(terms: list[str], title: Column, body: Column) -> Column:
    """Full-text score: words of the query in the title count 2, in the body 1 each."""
    words = lambda c: F.split(F.lower(c), "[^a-z0-9]+")
    hits = lambda c: F.size(F.filter(words(c), lambda w: w.isin(*terms)))
    return 2 * F.coalesce(hits(title), F.lit(0)) + F.coalesce(hits(body), F.lit(0))
