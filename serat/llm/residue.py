"""Template residue, filler, empty template values, error pages and demands for scripts in place of content.

Each kind has a grammar of its own.  A hit only counts where it stands for itself: placeholders outside quotations,
code and sentences that explain them, notices as whole sentences (not as the object of a reporting one), filler and
empty values by their density in a line.  Everything is decided within one text, so one pass without a shuffle does.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

#: Unfilled placeholders by their delimiters.
PLACEHOLDER = re.compile(
    r"(?=[{<$\[#_%@])(?:"  # no branch begins otherwise
    r"\{\{[^{}\n]+\}\}"
    r"|\{%[^%\n]+%\}"
    r"|<%=?[^%\n]+%>"
    r"|\$\{[^{}\n]+\}"
    r"|\[\[[^\[\]\n|]+\]\]"
    r"|(?<![{$\w])\{[A-Za-z][\w .-]*\}(?!\})"
    r"|(?<![#\w])##?[A-Z][A-Z_ ]+##?(?!#)"
    r"|(?<!\w)__[A-Z]+(?:_[A-Z]+)*__(?!\w)"
    r"|(?<![%\w])%[A-Z][A-Z_]+%"
    r"|(?<![$\w])\$[A-Z][A-Z_]+\$(?!\w)"
    r"|(?<![@\w])@@[A-Za-z][\w .-]*@@"
    r"|\[(?:[Mm]asukkan|[Ii]sikan|[Ii]si|[Tt]ulis|[Ii]nsert|[Yy]our|[Ee]nter|nama|judul)\b[^\]\[\n]*\]"
    r"|<(?!/)[a-z][a-z_]*(?: [a-z_]+)*>"
    r"|\[[A-Z]+(?:[ _][A-Z]+)+\]"
    r")"
)
#: Placeholders in single square or angle brackets may be tags instead.
HTML = frozenset("a b i u p br hr em li ol ul td tr th h1 h2 h3 h4 h5 h6 div img pre sub sup code span table strong small script style".split())
#: Names of template fields, which [IN BRACKETS] are placeholders although other words there are tags.
FIELDS = frozenset(
    "title judul nama name author penulis editor tanggal date kota city jumlah amount harga headline lead body isi berita topik kategori sumber narasumber foto image url link".split()
)
EXPLAINS = re.compile(r"(?i)\b(?:variabel|variable|placeholder|templat|template|sintaks|syntax|kode|code|skrip itu|penanda|lupa mengganti\w*|tutorial|perintah|fungsi|ditulis|diganti|dipakai untuk)\b")
CODE = re.compile(r"```.*?(?:```|\Z)|`[^`\n]+`|<(code|pre)>.*?</\1>", re.S)
QUOTED = re.compile(r"\"[^\"\n]*\"|“[^”\n]*”|”[^”\n]*”|«[^»\n]*»")

#: Notices that stand alone as a sentence; an error code or the word error may come first.
NOTICES = [
    # error pages
    r"(?:the |this )?page (?:you requested |you are looking for )?(?:was |could |can)?\s?(?:not|n't)(?: be)? (?:found|displayed)",
    r"page not found", r"not found", r"(?:bad )?gateway(?: timeout)?", r"bad gateway", r"bad request", r"forbidden", r"access denied", r"service (?:temporarily )?unavailable",
    r"internal server error", r"too many requests", r"request timed? ?out", r"connection timed out", r"unauthorized", r"something went wrong",
    r"you don't have permission to (?:view|access)@T@", r"please try again later", r"(?:the )?server (?:encountered|is)@T@",
    r"this (?:article|page|content) (?:has been removed|is no longer available|does not exist)",
    r"halaman (?:ini |yang anda (?:cari|minta|tuju) )?(?:tidak (?:ditemukan|tersedia|ada)|telah (?:dihapus|dipindahkan))",
    r"artikel (?:ini )?(?:tidak ditemukan|telah dihapus|sudah dihapus|tidak tersedia)(?: lagi)?",
    r"(?:galat|kesalahan) server(?: internal)?", r"server (?:sedang )?(?:sibuk|tidak (?:merespons|menanggapi))@T@", r"waktu koneksi habis", r"akses ditolak",
    r"layanan (?:sementara )?tidak tersedia(?: untuk sementara)?", r"terjadi kesalahan(?: pada (?:server|sistem|halaman ini))?", r"koneksi (?:terputus|gagal)", r"permintaan (?:tidak valid|ditolak)",
    r"situs (?:ini )?sedang dalam (?:perbaikan|pemeliharaan)",
    r"hubungi pengelola situs(?: bila masalah berlanjut)?", r"(?:coba )?muat ulang halaman(?: ini)?(?: beberapa saat lagi)?", r"silakan kembali ke (?:beranda|halaman utama)", r"kembali ke beranda",
    r"kami mohon maaf atas (?:gangguan|ketidaknyamanan)(?: ini)?", r"alamat yang anda tuju mungkin sudah (?:pindah|dihapus)", r"id permintaan\s*:?\s*[\w-]+", r"silakan coba (?:lagi|beberapa saat lagi)(?: nanti)?",
    # demands for scripts, cookies or a human check
    r"(?:please )?(?:enable|turn on|allow) (?:javascript|java script|scripts|cookies)@T@", r"(?:you need|you have) to (?:enable|turn on|allow) (?:javascript|scripts|cookies)@T@",
    r"javascript is (?:disabled|required|not enabled)@T@", r"this (?:site|page|website) (?:requires|needs) (?:javascript|cookies)@T@", r"your browser does not support@T@",
    r"checking (?:your browser|if the site connection is secure)@T@", r"(?:please )?(?:verify|confirm|prove) (?:that )?you(?:'re| are) (?:not a robot|(?:a )?human)", r"complete the captcha@T@",
    r"(?:harap |silakan |mohon )?(?:aktifkan|nyalakan|hidupkan) (?:javascript|skrip|cookie|kuki)@T@", r"(?:harap |silakan |mohon )?(?:izinkan|terima) (?:cookie|kuki|skrip)@T@",
    r"(?:situs|halaman|laman) ini (?:membutuhkan|memerlukan|tidak dapat dimuat tanpa|hanya dapat dibuka dengan) (?:javascript|skrip|cookie|kuki)@T@",
    r"peramban (?:anda|ini) tidak mendukung (?:javascript|skrip)@T@", r"memeriksa peramban anda@T@", r"(?:selesaikan|isi) captcha@T@",
    r"(?:harap |silakan )?(?:verifikasi|buktikan|pastikan|konfirmasi) bahwa anda (?:bukan robot|manusia)",
    # filler of a layout
    r"(?:ini adalah )?(?:teks|paragraf|kalimat|judul) (?:contoh|sementara|pengisi|tiruan)@T@", r"contoh (?:judul|teks|paragraf|isi)@T@", r"sample (?:paragraph|text|headline|title)@T@",
    r"ganti (?:kalimat|teks|paragraf|judul) ini dengan@T@", r"tulis (?:ringkasan|isi|judul|teks)@T@ di (?:bagian )?(?:sini|ini)", r"isi (?:berita|artikel|konten) akan (?:ditampilkan|muncul|tampil) di sini",
    r"konten belum tersedia(?:, teks sementara)?", r"(?:your|insert|enter|type) (?:your )?(?:text|content|title)(?: goes)? here", r"placeholder (?:text|headline|paragraph)@T@", r"dummy text@T@",
    r"(?:paragraf|teks|kalimat|bagian) ini hanya pengisi@T@", r"tambahkan (?:keterangan foto|judul|ringkasan|gambar)(?: di sini)?",
]
#: Notices made of slots: what it is about, and the state it is in.  The state ends the sentence.
_THING_EN = r"(?:(?:the|this|that|your|our|requested) )*(?:page|web ?site|site|article|content|resource|file|url|link|document|server|service|host|connection|request|session|account|gateway|domain|database connection|browser|java ?script)(?: you(?:'re| are| were)? (?:requested|requesting|looking for|trying to (?:view|reach|access|open)))?"
_STATE_EN = (
    r"(?:(?:(?:is|was|are|could|can|has|does|did|may|might)(?:n't| not| no longer)?|can't|cannot|won't|not|no longer) (?:been |be )?|)"
    r"(?:currently |temporarily |permanently )?(?:found|available|unavailable|(?:un)?able to [a-z ]+|working|displayed|reached|loaded|load|exist|exists|accessible|responding|respond|supported|authorized|expired|timed? ?out|removed|deleted|moved|blocked|reset|interrupted|closed|disabled|required|down|offline|busy|overloaded|unreachable|forbidden|denied|refused|under (?:maintenance|construction))"
    r"(?: on this server| in your (?:region|country|area)| at this time| right now| at the moment| temporarily| permanently)?"
)
_THING_ID = r"(?:halaman|laman|artikel|situs|konten|tautan|server|layanan|koneksi|permintaan|sesi|alamat|berkas)(?: web)?(?: ini| anda| yang (?:anda|kamu) (?:cari|minta|tuju|buka|maksud))?"
_STATE_ID = (
    r"(?:mungkin )?(?:tidak|tak|belum|gagal|sudah|telah|sedang)(?: lagi)?(?: dapat| bisa)?"
    r" (?:ditemukan|tersedia|ada|dimuat|dibuka|diakses|dijangkau|dihubungi|diproses|merespons|berfungsi|ditampilkan|dihapus|dipindahkan|kedaluwarsa|kadaluarsa|sibuk|terputus|berakhir|habis|dalam (?:perbaikan|pemeliharaan))(?: lagi)?(?: saat ini| untuk sementara)?"
)
NOTICES += [
    rf"{_THING_EN} {_STATE_EN}", rf"{_THING_ID} {_STATE_ID}", r"(?:request|session|connection|gateway|page) (?:time ?out|expired|refused|failed)",
    r"(?:just a moment|one more step|attention required|please stand by|please wait)(?:\.\.\.|[.!…])?(?=\s*(?:$|\n|[.!?…|A-Z]))", r"(?:verifying|confirming|checking (?:if|that|whether)) you are (?:not a robot|(?:a )?human)",
    r"(?:sorry, )?you have been (?:blocked|denied access)", r"(?:please )?complete the (?:security check|captcha|verification)@T@", r"(?:please )?turn (?:javascript|cookies) on@T@",
    r"(?:error )?(?:establishing|connecting to|opening) (?:a |the )?(?:database|server) (?:connection)?", r"(?:we've|we have) detected that (?:javascript|cookies)@T@", r"(?:it looks like )?nothing was found at this location",
    r"(?:unable|failed) to (?:connect|load|open|reach|process|resolve)@T@", r"gagal (?:memuat|membuka|menghubungi|menampilkan) (?:halaman|laman|situs|server|konten)(?: ini)?", r"koneksi ke (?:server|situs|basis data)(?: ini)? (?:gagal|terputus|ditolak)",
    r"(?:proxy|gateway|database|application|runtime|network|script|dns|tls|ssl) error", r"account suspended", r"(?:bandwidth|quota|rate) limit exceeded", r"(?:your|this) connection is not (?:private|secure)", r"peramban (?:anda|ini) (?:tidak|belum) didukung",
    r"to (?:continue|proceed)[^.\n]{0,3} (?:please )?(?:enable|allow|turn on|complete|verify)@T@", r"(?:i'm|i am|saya) (?:not|bukan) (?:a )?robot", r"(?:centang|klik|tekan) (?:kotak|tombol)(?: ini)? (?:untuk|guna) (?:membuktikan|memastikan|memverifikasi)@T@", r"click here if you are not redirected@T@",
    r"please stand by(?:,? while)?@T@", r"(?:hmm\W+)?we're having trouble (?:finding|loading|connecting to) (?:that|this|the) (?:site|page|server)", r"you may have mistyped the address@T@",
    r"anda tidak (?:memiliki|mempunyai|punya) (?:izin|akses|hak akses)(?: untuk)? (?:mengakses|membuka|melihat) (?:halaman|laman|situs|konten) ini", r"(?:sedang )?(?:memverifikasi|memastikan|memeriksa) (?:bahwa|apakah) anda (?:adalah )?(?:manusia|bukan robot)",
]
_STATUS = r"(?:(?:error|galat|http)\b[ :|#-]*)?(?:[45]\d\d\b[ :|.-]*)?(?:(?:error|galat)\b[ :|-]*)?"
#: The rest of a notice: words that don't begin with a capital letter, which begins the next.
_TAIL = r"(?-i:(?: [a-z0-9][\w'-]*){0,9})"
NOTICE = re.compile(rf"(?im)(?<![^\W_])(?:(?:maaf|sorry|oops|ups)\b[,!.]? )?{_STATUS}(?:{'|'.join(NOTICES).replace('@T@', _TAIL)})(?![^\W_])")
#: What stands after a notice.
ENDS = re.compile(r"[ \t]*(?:[.!?…|;]|\n|\Z|[-–»•:*]|(?=[A-Z0-9\[(\"])|xxx\b)")
SPACE = re.compile(r"\s*")
#: A status alone on its line.
STATUS_LINE = re.compile(r"(?im)^\W*(?:error|galat)[ :|#-]*[45]\d\d\W*$|^\W*[45]\d\d[ :|-]+(?:error|galat)\W*$")
LOREM = frozenset(
    "lorem ipsum dolor sit amet suspen potent nullam tortor vitae purus faucib perspi unde omnis iste natus accusam iusto odio dignis ducim blandi praese luctus donec fringi sagitt ultric pharet congue semper lacus turpis egestas vivamus nibh ligula rhoncus tellus lectus augue massa sapien eros interd condim hendre molest consec adipis elit sed eiusm tempor incid labor dolore magna aliqu enim minim venia quis nostr exerc ullam nisi commod conse duis aute irure repreh volup velit esse cillu fugia nulla paria except sint occae cupid proid sunt culpa offic deser mollit anim laborum pellen morbi tristiq senect vestib integer mauris vivam phasel curab".split()
)
#: Values that a template prints for nothing.
EMPTY = re.compile(r"(?=[#&(]|un|nu|ni|N[ao/]|\[o)(?:(?:undefined|null|NaN|None|nil|N/A|#REF!|#N/A|#NAME\?|#VALUE!|#DIV/0!|\[object Object\])(?![^\W_])|(?:&nbsp;?)+|\((?:tanpa judul|kosong|untitled|no title|empty)\))")


#: Where a notice may begin: after the end of a sentence or field, a dash, or (MENU) capitalised words of a menu from there on.
BOUNDARY = re.compile(r"(?:\A|[.!?:;\n|…»•>*\")]|(?<!\S)[-–])[ \t]*(?=[^\s])")
MENU = re.compile(r"[A-Z]\w*[ ,]*")


def _covered(spans: list[tuple[int, int]], at: int) -> bool:
    return any(a <= at < b for a, b in spans)


def _sentence(text: str, a: int, b: int) -> str:
    left = max(text.rfind(c, 0, a) for c in ("\n", ". ", "! ", "? ")) + 1
    ends = [e for c in ("\n", ". ", "! ", "? ") if (e := text.find(c, b)) >= 0]
    return text[left : min(ends, default=len(text))]


def _placeholders(text: str) -> bool:
    quoted = None
    for m in PLACEHOLDER.finditer(text):
        inner = m[0].strip("<>[]").lower()
        if m[0][0] == "<" and m[0][1] != "%" and inner.split(" ")[0] in HTML - FIELDS:
            continue
        if re.fullmatch(r"\[[A-Z _]+\]", m[0]) and not FIELDS & set(re.split(r"[ _]", inner)) and "FIRST" not in m[0]:
            continue
        if quoted is None:
            quoted = [s.span() for s in CODE.finditer(text)] + [q.span() for q in QUOTED.finditer(text) if len(PLACEHOLDER.sub('', q[0]).split()) < 4]
        if not _covered(quoted, m.start()) and not EXPLAINS.search(PLACEHOLDER.sub("", _sentence(text, *m.span()))):
            return True
    return False


def _starts(text: str) -> list[int]:
    """Places where a notice may begin, in order."""
    out = set()
    for m in BOUNDARY.finditer(text):
        at = m.end()
        if at in out:
            continue
        out.add(at)
        before = text[m.start() : at]
        if not before.strip() or before[0] in ".!?" and len(before) > 1:
            while word := MENU.match(text, at):
                at = word.end()
                out.add(at)
    return sorted(out)


def _notices(text: str) -> bool:
    last = -1  # end of the notice before
    for at in _starts(text):
        while at >= last and (m := NOTICE.match(text, at)) and m.end() > at:
            if ENDS.match(text, m.end()):
                # a notice that begins in the middle of a line as an ordinary word does so with a capital letter or a code
                before = text[:at].rstrip(" \t")
                if m[0][0].isupper() or m[0][0].isdigit() or not before or before[-1] == "\n" or last >= 0:
                    return True
            last = m.end()
            at = SPACE.match(text, last).end()
    return STATUS_LINE.search(text) is not None


WORD = re.compile(r"[^\W\d_]+")


@lru_cache(1 << 16)
def _is_latin(w: str) -> bool:
    return any(w.startswith(p) or len(w) > 3 and p.startswith(w) for p in LOREM)


def _latin(words) -> int:
    return sum(map(_is_latin, words))


def _filler(low: str) -> bool:
    """Runs of mock Latin: a sentence mostly of it, or of the ten words from lorem ipsum on most."""
    if _latin(set(WORD.findall(low))) < 2:
        return False  # every case below has two words of it
    for sentence in re.split(r"[.!?\n]", low):
        words = WORD.findall(sentence)
        if len(words) >= 4 and _latin(words) >= 0.6 * len(words):
            return True
        at = sentence.find("lorem ipsum")
        if at >= 0 and len(words := WORD.findall(sentence[at:])[:10]) >= 2 and _latin(words) >= min(6, len(words)):
            return True
    return False


def _empty_values(text: str) -> bool:
    blocks = [x for x in text.split("\n\n") if x.strip()]
    for block in blocks:
        lines = [x for x in block.split("\n") if x.strip()]
        full = n = 0
        for line in lines:
            if not (hits := EMPTY.findall(line)):
                continue
            rest = re.findall(r"[^\W_]+", EMPTY.sub(" ", line))
            # label and value, or values with a few words of navigation between
            if len(rest) <= 3 and len(rest) <= max(1, 2 * len(hits)):
                n += len(hits)
                full += 1
        if n >= 2 or full and full == len(lines) and len(blocks) == 1:
            return True
    return False


def residue_kind(text: str | None) -> str | None:
    """The first kind of residue in a text: placeholder, filler, empty value, notice; None if there is none."""
    if not text:
        return None
    if _placeholders(text):
        return "placeholder"
    if _filler(text.lower()):
        return "filler"
    if EMPTY.search(text) and _empty_values(text):
        return "empty value"
    if _notices(text):
        return "notice"
    return None


def find_residue(docs: DataFrame) -> DataFrame:
    """(id, kind) of the documents (id BIGINT, text STRING) with template residue in place of content, wholly or in part.

    Null and empty texts have none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = pa.array([residue_kind(t.as_py()) for t in batch.column(1)], pa.string())
            keep = kinds.is_valid()
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), kinds.filter(keep)], ["id", "kind"])

    return docs.toDF("id", "text").where("text <> ''").mapInArrow(run, "id long, kind string")
