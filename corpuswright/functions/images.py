"""Image filters, MIME sniffing and figure placement."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab


def _any(col: Column, parts) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(col, F.lit(p)) for p in parts])


def is_decorative_web(url: Column, alt: Column) -> Column:
    """Advertising or decoration by URL words, alt words or a chat GIF."""
    low = F.lower(url)
    return (
        _any(low, vocab.WEB_IMAGE_URL_HINTS)
        | _any(F.lower(F.coalesce(alt, F.lit(""))), vocab.WEB_IMAGE_ALT_HINTS)
        | (low.endswith(".gif") & F.contains(low, F.lit("mmbiz")))
    )


def is_svg(url: Column) -> Column:
    low = F.lower(url)
    return low.endswith(".svg") | F.contains(low, F.lit(".svg?"))


def keep_web_images(images: Column) -> Column:
    """Images with a URL that are neither decorative nor SVG, order kept."""
    return F.filter(
        images,
        lambda i: (F.coalesce(i["url"], F.lit("")) != "") & ~is_decorative_web(i["url"], i["alt"]) & ~is_svg(i["url"]),
    )


def is_decorative_article(
    src: Column, data_type: Column, width: Column, context: Column, position: Column
) -> Column:
    """Article policy: words in the URL, small GIF, icon, closing QR code, edge GIF.

    ``position`` is the relative place in the article (0..1), ``context`` the
    class names and text around the image.
    """
    px = F.coalesce(F.replace(width, F.lit("px"), F.lit("")).try_cast("int"), F.lit(-1))
    url = F.coalesce(src, F.lit(""))
    edge = (position < 0.2) | (position > 0.8)
    return (
        _any(F.lower(url), vocab.ARTICLE_IMAGE_URL_HINTS)
        | ((F.coalesce(data_type, F.lit("")) == "gif") & (px >= 0) & (px < 100))
        | ((px > 0) & (px < 50))
        | ((position > 0.8) & _any(F.lower(F.coalesce(context, F.lit(""))), vocab.ARTICLE_QR_HINTS))
        | (F.contains(url, F.lit("mmbiz_gif")) & edge)
    )


def mime_type(content: Column) -> Column:
    """MIME type by magic bytes; PNG when unknown."""
    head = F.hex(F.substring(content, 1, 12))
    return (
        F.when(head.startswith("FFD8FF"), "image/jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "image/png")
        .when(head.startswith("52494646") & head.endswith("57454250") & (F.length(head) == 24), "image/webp")
        .when(head.startswith("474946383761") | head.startswith("474946383961"), "image/gif")
        .when(head.startswith("0000001C") | head.startswith("00000020"), "image/avif")
        .otherwise("image/png")
    )


def integrate_figures(content: Column, images: Column) -> Column:
    """Put each image at its placeholder, or at the end when there is none."""

    def place(text: Column, img: Column) -> Column:
        src = F.when(F.coalesce(img["local_path"], F.lit("")) != "", img["local_path"]).otherwise(img["url"])
        no = (img["index"] + 1).cast("string")
        alt = F.when(F.coalesce(img["alt"], F.lit("")) != "", img["alt"]).otherwise(F.concat(F.lit("图 "), no))
        note = F.when(
            F.coalesce(img["description"], F.lit("")) != "",
            F.concat(F.lit("\n\n> **图 "), no, F.lit("**: "), img["description"]),
        ).otherwise("")
        figure = F.concat(F.lit("!["), alt, F.lit("]("), src, F.lit(")"), note)
        mark = F.concat(F.lit("[IMAGE_"), img["index"].cast("string"), F.lit(":"))
        pattern = F.concat(F.lit(r"\[IMAGE_"), img["index"].cast("string"), F.lit(r":.*?\]"))
        quoted = F.regexp_replace(figure, r"([\\$])", r"\\$1")
        placed = F.when(F.contains(text, mark), F.regexp_replace(text, pattern, quoted)).otherwise(
            F.concat(text, F.lit("\n\n"), figure)
        )
        return F.when(F.coalesce(src, F.lit("")) == "", text).otherwise(placed)

    return F.aggregate(images, content, place)
