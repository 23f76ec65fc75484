"""Fixed values of the document register: supplier, file type and document type codes."""

from __future__ import annotations

# Code and description.
SUPPLIERS = {
    "SA": "Stadsdeel Centrum",
    "SC": "Stadsdeel Westerpark",
    "SD": "Stadsdeel Oud-West",
    "SG": "Stadsdeel Zeeburg",
    "SH": "Stadsdeel Bos en Lommer",
    "SJ": "Stadsdeel De Baarsjes",
    "SN": "Stadsdeel Noord",
    "SP": "Stadsdeel Geuzenveld-Slotermeer",
    "SQ": "Stadsdeel Osdorp",
    "SR": "Stadsdeel Slotervaart",
    "ST": "Stadsdeel Zuidoost",
    "SU": "Stadsdeel Oost-Watergraafsmeer",
    "SV": "Stadsdeel Oud-Zuid",
    "SW": "Stadsdeel Zuideramstel",
    "SE": "Stadsdeel West",
    "SF": "Stadsdeel Nieuw-West",
    "SK": "Stadsdeel Zuid",
    "SM": "Stadsdeel Oost",
    "WP": "Stadsgebied Weesp",
    "BD": "Bestuursdienst",
    "DW": "Wonen",
    "MB": "Omgevingsdienst NZKG",
    "OG": "Grond en Ontwikkeling",
    "RO": "Ruimte en Duurzaamheid",
    "ZA": "Zuidas",
    "PC": "PostNL",
    "GV": "Gegevensbeheer (Basisinformatie)",
    "TM": "Terugmelding",
    "SB": "Straatnaambesluit",
}

# Fixed values.
FILE_TYPES = {
    "OV": "Omgevingsvergunning",
    "BL": "Lichte bouwvergunning",
    "NB": "Losse nummerbeschikking",
    "RB": "Reguliere nummerbeschikking",
    "SB": "Besluit openbare ruimte",
    "SL": "Sloopvergunning",
    "VW": "Samenvoegingsvergunning",
    "SV": "Splitsingsvergunning",
    "OR": "Verklaring registratie object Wet BAG",
    "AC": "Ambtshalve correctie",
    "WO": "Woningonttrekking zonder omgevingsvergunning",
    "TM": "Terugmelding",
}

# Fixed values.
DOCUMENT_TYPES = {
    "VL": "Voorloopvel",
    "BA": "Aanvraag omgevingsvergunning voor bouwen/slopen/splitsing/woningonttrekking",
    "VG": "Omgevingsvergunning voor bouwen/slopen/splitsing/woningonttrekking",
    "BT": "Bouwtekening",
    "ST": "Situatietekening",
    "SB": "Besluit openbare ruimte",
    "NB": "Nummerbeschikking / Besluit stand- of ligplaats",
    "GC": "Voorlopige pandgeometrie",
    "GM": "Definitieve geometrie object-GM: 0-99",
    "GN": "Definitieve geometrie object-GN: 100-199",
    "GO": "Definitieve geometrie object-GO: 200-299",
    "GP": "Definitieve geometrie object-GP: 300-399",
    "OR": "Verklaring registratie object Wet BAG",
    "ML": "Statusmelding",
    "AT": "Aantekening (notitie) op een dossier",
    "MF": "Statusformulier niet te registreren",
    "AC": "Ambtshalve correctie",
    "TM": "Terugmelding (in onderzoek zetten)",
    "OP": "Terugmelding (uit onderzoek halen)",
}

# Suppliers whose documents are imported.
IMPORTED_SUPPLIERS = [
    "GV",
    "MB",
    "PC",
    "RO",
    "SB",
    "TM",
    "SA",
    "SC",
    "SD",
    "SE",
    "SF",
    "SG",
    "SH",
    "SJ",
    "SK",
    "SM",
    "SN",
    "SP",
    "SQ",
    "SR",
    "ST",
    "SU",
    "SV",
    "SW",
    "WP",
]

# Fixed value: the one known duplicate, as (subject1, subject2).
KNOWN_DUPLICATE = ("\\IMPDOCSA\\", "SE06894773_OV00ML.pdf")
