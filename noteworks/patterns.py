"""Patterns of personal and of specially protected data (Java regex, Unicode classes)."""

from __future__ import annotations

UPPER = "A-ZÀÂÄÉÈÊËÏÎÔÙÛÜŸÇ"
LOWER = "a-zàâäéèêëïîôùûüÿç"

EMAIL = r"(?iU)\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"
PHONES = (
    r"(?U)\b0[1-9](?:[\s.-]?\d{2}){4}\b",
    r"(?U)\+\d{1,3}[\s.-]?\d{1,4}(?:[\s.-]?\d{2,4}){2,4}\b",
    r"(?U)\(\d{2,3}\)[\s.-]?\d{3}[\s.-]?\d{4}\b",
)
POSTAL = rf"(?iU)\b\d{{5}}\s+[{UPPER}][{LOWER}]+(?:[\s-][{UPPER}][{LOWER}]+)*\b"
STREETS = (
    r"(?iU)\b\d+\s+(?:rue|avenue|av\.|boulevard|bd\.|place|impasse|allée|chemin|quai|cours)\s+"
    r"[A-Za-zÀ-ÿ\s-]+(?=\s*,|\s*\d{5}|\.|$)",
    r"(?iU)\b(?:bâtiment|batiment|bat\.|appartement|appt\.|étage|escalier)\s+[A-Za-z0-9]+\b",
)
CREDIT_CARD = r"(?U)\b(?:\d{4}[\s-]?){3}\d{4}\b"
IBAN = r"(?U)\b[A-Z]{2}\d{2}[\s]?(?:\d{4}[\s]?){3,7}\d{1,4}\b"
ID_NUMBER = r"(?U)\b\d{12}\b"
BIRTH_DATES = (
    r"(?iU)\b(?:né|née|naissance|né le|née le)[:\s]+\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b",
    r"(?U)\b\d{1,2}[/-]\d{1,2}[/-](?:19|20)\d{2}\b",
)
IP_ADDRESS = r"(?U)\b(?:\d{1,3}\.){3}\d{1,3}\b"
TITLES = r"\b(?:M\.|Mr\.|Monsieur|Mme|Madame|Mlle|Mademoiselle|Dr\.|Docteur|Prof\.|Professeur)"
NAME_AFTER_TITLE = rf"{TITLES}\s+[{UPPER}][{LOWER}]+(?:\s+[{UPPER}][{LOWER}]+){{0,2}}"
CAPITALISED_RUN = rf"(?U)(?<=[.!?]\s)\b[{UPPER}][{LOWER}]+(?:\s+[{UPPER}][{LOWER}]+){{1,2}}\b"

# Protected categories: category -> patterns, matched without regard to case.
SENSITIVE = {
    "HEALTH_DATA": (
        r"\b(?:diab[eè]t\w*|cancer\w*|tumeur\w*|tumor\w*|asthm\w*|épileps\w*|epileps\w*|VIH|HIV|sida|aids)\b",
        r"\b(?:maladie\w*|disease\w*|illness\w*|patholog\w*|symptôm\w*|symptom\w*|diagnostic\w*|diagnosis)\b",
        r"\b(?:allergi\w*|allergy|intol[eé]ran\w*|handicap\w*|disabilit\w*|infirmit\w*)\b",
        r"\b(?:m[eé]dicament\w*|medication\w*|medicine\w*|traitement\s+médical\w*|ordonnance\w*|prescription\w*)\b",
        r"\b(?:hospitalis\w*|chirurgi\w*|surgery|opéra[tion]+\s+(?:médical|chirurgical)\w*)\b",
        r"\b(?:dépression\w*|depression\w*|anxi[eé]t\w*|anxiety|psychiatr\w*|psycholog\w*|th[eé]rapi\w*)\b",
        r"\b(?:grossesse\w*|pregnancy|enceinte\w*|pregnant|fausse\s+couche|miscarriage)\b",
        r"\b(?:troubles?\s+(?:alimentaire|eating)|anorexi\w*|boulimi\w*|bulimi\w*)\b",
    ),
    "SEXUAL_ORIENTATION": (
        r"\b(?:homosexu|hétérosexu|heterosexu|bisexu|pansexu|asexu)\w*\b",
        r"\b(?:orientation\s+sexuelle|sexual\s+orientation|identit[eé]\s+(?:de\s+genre|sexuelle))\b",
        r"\b(?:LGBT|LGBTQ|queer|transgenre|transgender|non[- ]binaire|non[- ]binary)\b",
        r"\b(?:gay|lesbien\w*|lesbian)\b",
        r"\b(?:vie\s+sexuelle|sex\s+life|partner\s+sexuel)\b",
    ),
    "RELIGIOUS_BELIEF": (
        r"\b(?:musulman\w*|muslim\w*|islam\w*|chrétien\w*|christian\w*|catholi\w*|protestant\w*|évangéli\w*"
        r"|evangelical\w*)\b",
        r"\b(?:juif|juive|jewish|judaï\w*|bouddhist\w*|buddhist\w*|hindou\w*|hindu\w*|sikh\w*|athé\w*|atheist\w*"
        r"|agnosti\w*)\b",
        r"\b(?:religion\w*|religieu\w*|religious|croyance\w*|belief\w*|culte\w*|worship\w*|pratiquant\w*"
        r"|practicing)\b",
        r"\b(?:ramadan|shabbat|carême|lent|halal|casher|kosher|prière\w*|prayer\w*|mosquée\w*|mosque\w*"
        r"|synagogue\w*|temple\w*|église\w*|church\w*)\b",
    ),
    "POLITICAL_OPINION": (
        r"\b(?:opinion\s+politique|political\s+opinion|convictions?\s+politiques?)\b",
        r"\b(?:parti\s+politique|political\s+party|militant\w*|activism\w*|activiste\w*|activist\w*)\b",
        r"\b(?:extrême\s+(?:droite|gauche)|far[- ](?:right|left)|syndical\w*|trade\s+union)\b",
        r"\b(?:adhérent\w*|member\s+of\s+party|vote\s+pour|voted\s+for|sympathisant\w*|supporter\w*)\b",
        r"\b(?:grève\w*|strike\w*|manifesta[tion]+\s+politique|political\s+protest)\b",
    ),
    "ETHNIC_ORIGIN": (
        r"\b(?:origine\s+(?:ethnique|raciale)|ethnic\s+(?:origin|background)|racial\s+origin)\b",
        r"\b(?:couleur\s+de\s+peau|skin\s+colo[u]?r)\b",
    ),
    "TRADE_UNION": (
        r"\b(?:syndicat\w*|trade\s+union|union\s+member|adhésion\s+syndicale|syndiqué\w*)\b",
        r"\b(?:CGT|CFDT|UNSA|comité\s+d'entreprise|works\s+council)\b",
    ),
    "CRIMINAL_RECORD": (
        r"\b(?:casier\s+judiciaire|criminal\s+record|condamna[tion]+\w*)\b",
        r"\b(?:infraction\w*|offense\w*|délit\w*|misdemeanor\w*|felony|crime\b|criminel\w*)\b",
        r"\b(?:garde\s+à\s+vue|détention\w*|detention\w*|prison\w*|emprisonnem\w*|incarcér\w*)\b",
        r"\b(?:procès|jugement\w*|judgment\w*|court\s+(?:case|hearing))\b",
    ),
    "FINANCIAL_DIFFICULTY": (
        r"\b(?:surendett\w*|over[- ]indebt\w*|dette[s]?|debt[s]?\b|insolvab\w*|insolven\w*)\b",
        r"\b(?:faillite\w*|bankruptcy|redressement\s+judiciaire|liquidation\s+judiciaire)\b",
        r"\b(?:interdit\s+bancaire|banking\s+ban|fichier?\s+(?:Banque\s+de\s+France|FICP))\b",
        r"\b(?:saisie\w*|seizure\w*|huissier\w*|bailiff\w*|recouvrement\s+de\s+(?:dette|créance))\b",
    ),
    "FAMILY_CONFLICT": (
        r"\b(?:divorce\w*|séparation\s+(?:judiciaire|conjugale)|legal\s+separation)\b",
        r"\b(?:garde\s+(?:des?\s+enfants?|alternée|exclusive)|child\s+custody)\b",
        r"\b(?:pension\s+alimentaire|alimony|child\s+support)\b",
        r"\b(?:violence\s+(?:conjugale|domestique|familiale)|domestic\s+(?:violence|abuse))\b",
        r"\b(?:ordonnance\s+de\s+protection|restraining\s+order|harcèlement\s+(?:conjugal|familial))\b",
    ),
    "PHYSICAL_APPEARANCE": (
        r"\b(?:physique\s+(?:disgracieu\w*|ingrat\w*|repoussant\w*)|ugly|unattractive)\b",
        r"\b(?:ob[eè]se\w*|obesity|surpoids\w*|overweight|anorexique\w*|maigre\s+(?:excessif|extreme))\b",
        r"\b(?:cicatrice\w*|scarr(?:ed|ing)\b|difformit\w*|deformit\w*|infirmit[eé]\s+(?:visible|physique))\b",
        r"\b(?:commentaire\s+sur\s+(?:le\s+)?physique|body\s+shaming)\b",
    ),
}
HARMLESS_CONTEXT = (
    r"(?iU)\b(?:tissu\w*|motif\w*|bijou\w*|style\w*|imprimé\w*|fabric\w*|print\w*|pattern\w*|Amérique|America"
    r"|hémisphère|hemisphere|du\s+Sud|d'Asie|tribunal\s+(?:supérieur\w*|administratif\w*|de\s+commerce)"
    r"|juge[za]?\s+tribunal|convictions?\s+(?:éthique\w*|morale\w*|religieu\w*|personnelle\w*|ethical\w*"
    r"|moral\w*|personal\w*))\b"
)
