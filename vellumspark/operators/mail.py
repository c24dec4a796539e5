"""Mail as rows: which attachments are worth reading, and whether a message carries paperwork."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellumspark.functions.text import fold

from . import extract

#: Words in a subject that speak for a document.
SUBJECT = (
    r"factura|recibo|poliza|contrato|garantia|notificacion|requerimiento|liquidacion|multa|sancion|renovacion|vencimiento|aviso\s+de\s+cargo|tu\s+factura|extracto|presupuesto|justificante|resolucion|citacion|"
    r"invoice|receipt|policy|renewal|statement|your\s+order|confirmacion\s+de\s+(?:compra|pedido)|ticket"
)
#: Signs of advertising and their weights.
ADVERTS = [
    (r"newsletter|boletin\s+informativo|boletin\s+de\s+noticias", 3), (r"\boferta|ofertas|rebajas|black\s+friday|cyber\s+monday", 3), (r"\d+\s*%\s*(?:de\s+)?(?:descuento|dto)|descuento\s+del?\s+\d+", 3),
    (r"darte\s+de\s+baja|dar\s+de\s+baja|unsubscribe|cancelar\s+suscripcion\s+a\s+(?:nuestro|esta)", 2), (r"has\s+(?:recibido|ganado)|sorteo|promocion|cupon|codigo\s+promocional", 2),
    (r"te\s+recomendamos|novedades|lo\s+mas\s+vendido", 2), (r"\bmarketing\b|publicidad", 1),
]
#: Senders whose mail is social, and what that weighs.
SOCIAL = r"facebook|facebookmail|linkedin|twitter|x\.com|instagram|tiktok|youtube|pinterest|reddit|snapchat|telegram\.org|discord|twitch|quora|medium\.com|substack"
SOCIAL_WEIGHT = 4
#: Images below this size are logos and signatures.
LEAST_IMAGE = 40_000
OFFICES = ("admin", "utility", "telco", "insurer", "bank")


def is_pdf(a: Column) -> Column:
    return F.lower(a["name"]).endswith(".pdf") | F.coalesce(a["mime"] == "application/pdf", F.lit(False))


def readable(attachments: Column) -> Column:
    """The stored attachments that are documents: PDFs, and images that are large enough and not named as decoration."""

    def keep(a: Column) -> Column:
        name = F.lower(F.coalesce(a["name"], F.lit("")))
        picture = name.rlike(r"\.(png|jpe?g|webp|heic|tiff?)$") & (F.coalesce(a["size"], F.lit(0)) >= LEAST_IMAGE) & ~name.rlike("logo|firma|signature|banner|facebook|twitter|linkedin")
        return a["sha"].isNotNull() & (is_pdf(a) | picture)

    return F.filter(F.coalesce(attachments, F.array().cast("array<struct<name:string,size:bigint,mime:string,sha:string>>")), keep)


def classify(messages: DataFrame, id_col: str = "id") -> DataFrame:
    """(doc, kind, score, attachments): doc, maybe or noise, from subject, text, sender, attachments and the sender's trade.

    messages: id, subject, text, sender, trade, from_self, attachments array<struct<name,size,mime,sha>>. Own mail is noise.
    """
    m = messages.withColumn("_t", F.concat_ws("\n", F.coalesce("subject", F.lit("")), F.coalesce("text", F.lit(""))))
    body = extract.kinds(m, id_col, "_t", "trade").select(F.col("doc").alias("_id"), F.col("kind").alias("_body"), F.col("score").alias("_score"))
    folded = fold("_t")
    noise = sum((F.when(folded.rlike(p), w).otherwise(0) for p, w in ADVERTS), F.when(fold("sender").rlike(SOCIAL), SOCIAL_WEIGHT).otherwise(0))
    kept = readable(F.col("attachments"))
    m = m.select(F.col(id_col).alias("doc"), "trade", "from_self", noise.alias("noise"), F.size(kept).alias("files"), F.size(F.filter(kept, is_pdf)).alias("pdfs"), F.coalesce(fold("subject").rlike(SUBJECT), F.lit(False)).alias("subject"))
    m = m.join(body, m["doc"] == body["_id"])
    known, paper = F.coalesce(F.col("trade").isin(*OFFICES), F.lit(False)), F.col("_body") != "other"
    score = F.when(F.col("pdfs") > 0, 8).when(F.col("files") > 0, 4).otherwise(0) + F.when(F.col("subject"), 3).otherwise(0) + F.when(paper, F.least(F.col("_score"), F.lit(10))).otherwise(0) + F.when(known, 2).otherwise(0) - F.col("noise") * 2
    shop = F.coalesce(F.col("trade") == "shop", F.lit(False)) & ~F.col("subject")
    # the first that holds decides
    decisions = [
        ("doc", (F.col("pdfs") > 0) & (F.col("noise") < 4)),
        ("doc", paper & (F.col("_score") >= 10) & (F.col("noise") < 3) & ~shop),
        ("noise", (F.col("noise") >= 3) & (F.col("pdfs") == 0)),
        ("maybe", ((F.col("files") > 0) | F.col("subject") | paper) & (score >= 3)),
    ]
    kind = F.coalesce(*[F.when(holds, name) for name, holds in decisions], F.lit("noise"))
    own = F.coalesce("from_self", F.lit(False))
    return m.select("doc", F.when(own, "noise").otherwise(kind).alias("kind"), F.when(own, 0).otherwise(score).cast("long").alias("score"), F.when(own, 0).otherwise(F.col("files")).cast("long").alias("attachments"))
