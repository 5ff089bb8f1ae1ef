"""Legal forms at the end of company names, and names without them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Endings that name a legal form, as normalized names have them (upper case, signs as spaces), by where they
# are used.
LEGAL_FORMS = (
    # English-speaking
    "LIMITED", "LTD", "CO LTD", "COMPANY LIMITED", "PLC", "P L C", "PUBLIC LIMITED COMPANY", "LLP", "L L P", "LIMITED LIABILITY PARTNERSHIP",
    "LP", "L P", "LIMITED PARTNERSHIP", "LLLP", "LLC", "L L C", "LIMITED LIABILITY COMPANY", "PLLC", "INC", "INCORPORATED", "CORP",
    "CORPORATION", "COMPANY", "CO", "CIC", "COMMUNITY INTEREST COMPANY", "UNLIMITED", "PTY", "PTY LTD", "PROPRIETARY LIMITED", "PTE", "PTE LTD",
    "PVT LTD", "PRIVATE LIMITED", "SDN BHD", "BHD", "BERHAD", "LTEE", "LTÉE",
    # German
    "GMBH", "GMBH CO KG", "GMBH CO OHG", "GGMBH", "MBH", "GESMBH", "GES M B H", "AG", "AG CO KG", "KG", "KGAA", "OHG", "UG", "UG HAFTUNGSBESCHRÄNKT",
    "GBR", "EG", "E G", "EV", "E V", "EK", "E K", "SE",
    # French, Dutch, Luxembourgish, Swiss
    "SA", "S A", "SARL", "S A R L", "SAS", "S A S", "SASU", "EURL", "SNC", "S N C", "SCA", "SCI", "SCOP", "SCS", "SCSP", "GIE", "SPRL", "ASBL",
    "SICAV", "SAGL", "BV", "B V", "NV", "N V", "BVBA", "CVBA", "VOF", "V O F", "CV", "VZW",
    # Italian, Spanish, Portuguese
    "SPA", "S P A", "SRL", "S R L", "SRLS", "SAPA", "SCARL", "SL", "S L", "SLU", "S L U", "SAU", "S A U", "SA DE CV", "S A DE C V", "SAPI DE CV",
    "S DE RL DE CV", "S DE R L DE C V", "LTDA", "LDA", "EIRELI", "CIA LTDA",
    # Nordic and Baltic
    "AB", "AB PUBL", "KB", "HB", "AS", "A S", "ASA", "ANS", "APS", "OY", "OY AB", "OYJ", "EHF", "HF", "OU", "OÜ", "UAB", "SIA",
    # Eastern and south-eastern Europe, Turkey
    "SP Z O O", "SP ZOO", "SPZOO", "SPOLKA Z O O", "SPÓŁKA Z O O", "SPOLKA AKCYJNA", "SPÓŁKA AKCYJNA", "SRO", "S R O", "SPOL S R O", "KFT", "BT", "RT",
    "ZRT", "NYRT", "DOO", "D O O", "DD", "D D", "AD", "OOD", "EOOD", "EAD", "OOO", "OAO", "ZAO", "PAO", "AE", "EPE", "LTD STI", "LTD ŞTI", "AŞ", "A Ş",
    # Asia and the Gulf
    "KK", "K K", "KABUSHIKI KAISHA", "GK", "GODO KAISHA", "YK", "TBK", "JSC", "OJSC", "CJSC", "PJSC", "PSC", "QSC", "WLL", "W L L", "SAL", "SAOG", "FZE",
    "FZCO", "FZ LLC",
)
_SIZES = sorted({len(f.split(" ")) for f in LEGAL_FORMS}, reverse=True)


def legal_base(name: Column | str) -> Column:
    """A normalized name without its legal form. Two passes, as forms stand inside forms ("CO LTD", "INC PLC"); a pass takes one
    ending of each number of words away, the longest first. A name that is nothing but forms is null. Expressions only:
    a fold over the numbers of words, in which the words at the end are looked up."""
    c = F.col(name) if isinstance(name, str) else name

    def without(tokens: Column, k: Column) -> Column:
        ending = F.array_join(F.slice(tokens, F.greatest(F.size(tokens) - k + 1, F.lit(1)), k), " ")
        return F.when((F.size(tokens) >= k) & ending.isin(list(LEGAL_FORMS)), F.slice(tokens, F.lit(1), F.size(tokens) - k)).otherwise(tokens)

    left = F.aggregate(F.array(*map(F.lit, _SIZES * 2)), F.split(c, " "), without)
    return F.nullif(F.array_join(left, " "), F.lit(""))
