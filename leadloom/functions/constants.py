"""Fixed values of the lead rules: lists, patterns, points and limits. They are parts of the results' definition."""

from __future__ import annotations

# ---- fixed values: addresses ------------------------------------------------
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
MAILTO = r"""mailto:([^"'?>\s]+)"""
ROLE_LOCALS = (
    "info contact hello hi sales admin support noreply no-reply marketing hr jobs careers booking bookings appointment appointments "
    "reception office team enquiry enquiries inquiry inquiries mail email service services customercare help feedback webmaster finance "
    "accounts billing news abuse postmaster general operations ops frontdesk press media pr cs reservations reservation banqueting "
    "catering events concierge"
).split()
PLACEHOLDER_LOCALS = (
    "yourname your.name your_email youremail name firstname lastname fname lname first.last first last example sample test user username "
    "johndoe john.doe janedoe jane.doe email your abc xyz you youre j.doe jdoe jdoe1 jd a.b x.y aa.bb maxmustermann max.mustermann "
    "erika.mustermann mustermann jeandupont jean.dupont jean.martin marioorossi mario.rossi mariorossi juan.perez juanperez jankowalski "
    "jan.kowalski jandoe nomeprenome nome nom prenom vorname nachname apellido cognome imie nazwisko ihre ihr deine votre vos ton tu tuo "
    "tua suo su seu sua uw jouw din ditt dein"
).split()
FREEMAIL = "gmail.com yahoo.com hotmail.com outlook.com icloud.com protonmail.com proton.me live.com aol.com msn.com".split()
JUNK = (
    r"\.(png|jpg|jpeg|gif|svg|webp|ico|css|js|woff2?|ttf|eot|mp4|pdf|html?)$",
    r"@(example\.com|example\.org|sentry\.io|wpforms\.com|wixpress\.com|wix\.com|godaddy\.com|sentry-next|domain\.com|email\.com|yourdomain\.com|company\.com|surname\.com|name\.com|firstname\.com|test\.com|sample\.com|acme\.com|placeholder)",
    r"^(\d+x|[a-f0-9]{16,})@",
    r"@(e-?mail|domain|your-?domain|example|beispiel|ejemplo|esempio|exemple)\.[a-z]{2,4}(\.[a-z]{2,3})?$",
)
SECOND_LEVEL = "com net org co gov med".split()
VARIANT_TLDS = ".com .ae .sa .com.sa .qa .com.qa .bh .com.bh .kw .com.kw .me .org .net .net.sa .net.ae".split()
GROUP_SUFFIXES = "retailgroup group health clinics clinic company".split()
GROUP_TLDS = ".com .ae .sa .qa .bh .kw".split()

# ---- fixed values: intake and size of a site --------------------------------
INTAKE = {
    "whatsapp": r"whatsapp|wa\.me/",
    "form": r"""<form|contact[-_ ]form|name="email"|input[^>]*email""",
    "book": r"book[-_ ]now|book[-_ ]online|book[-_ ]appointment|book[-_ ]your",
    "pdf_menu": r"\.pdf.*menu|menu.*\.pdf",
    "platform": r"calendly|setmore|fresha|simplybook|nookal|zenoti|10to8|appointy|squareup|acuityscheduling",
}
HOTEL_VERTICALS = "hotel hotels resort resorts bnb guesthouse guesthouses".split()
ROOMS = r"(\d{2,4})\s*(?:\+|plus)?\s*(?:guest\s*)?(?:rooms|bedrooms|suites|keys|habitaciones|chambres|camere|zimmer)(?:[^a-z0-9_]|$)"
SCALE_WORDS = (
    "resort", "spa", "conference", "convention", "congress", "ballroom", "banquet", "meetings", "mice", "palace", "grand hotel",
    "wedding venue", "rooftop", "5-star", "5 star", "five star", "five-star", "4-star", "4 star", "four star", "four-star",
    "cinco estrellas", "cuatro estrellas", "5 estrellas", "4 estrellas", "5 etoiles", "5 étoiles", "4 etoiles", "4 étoiles", "5 stelle", "4 stelle",
)
WEAK_WORDS = ("spa",)
FIVE_STAR = r"5[\s-]?star|five[\s-]?star|cinco estrellas|5 estrellas|5\s*[ée]toiles|5 stelle"
FOUR_STAR = r"4[\s-]?star|four[\s-]?star|cuatro estrellas|4 estrellas|4\s*[ée]toiles|4 stelle"

# ---- fixed values: traffic --------------------------------------------------
REVIEWS = {
    "reviews_jsonld": (r'"(?:reviewcount|ratingcount)"\s*:\s*"?(\d{1,9})"?',),
    "reviews_microdata": (
        r"""itemprop\s*=\s*["'](?:reviewcount|ratingcount)["'][^>]{0,120}?content\s*=\s*["'](\d{1,9})["']""",
        r"""content\s*=\s*["'](\d{1,9})["'][^>]{0,120}?itemprop\s*=\s*["'](?:reviewcount|ratingcount)["']""",
    ),
    "reviews_text": (r"(\d[\d.,]{0,11})\s*(?:reviews?|ratings?|opiniones|avis|recensioni|bewertungen)(?:[^a-z0-9_]|$)",),
}
REVIEW_TEXT_IN = r"""<([a-z0-9-]+)[^>]*itemprop\s*=\s*["'](?:reviewcount|ratingcount)["'][^>]*>\s*(\d[\d.,]{0,11})"""
VOID_TAGS = "meta link img br hr input".split()
REVIEW_CLAMP = 50_000
REVIEW_POINTS = ((500, 40), (100, 30), (25, 20), (1, 10))
TRACKERS = {
    "ga4": r"gtag/js\?id=g-|googletagmanager\.com/gtag",
    "gtm": r"gtm-[a-z0-9]{4,}|googletagmanager\.com/gtm\.js",
    "meta_pixel": r"""fbq\s*\(\s*["']init["']|connect\.facebook\.net/[^"']*fbevents\.js""",
    "google_ads": r"""googleadservices\.com|["']aw-\d{6,}""",
    "hotjar": r"static\.hotjar\.com|hjid\s*[:=]",
    "clarity": r"clarity\.ms/tag",
    "segment": r"cdn\.segment\.com|analytics\.load\s*\(",
    "mixpanel": r"cdn\.mxpnl\.com|mixpanel\.init\s*\(",
    "tiktok": r"analytics\.tiktok\.com",
    "linkedin_insight": r"snap\.licdn\.com|_linkedin_partner_id",
}
CHAT = r"widget\.intercom\.io|embed\.tawk\.to|client\.crisp\.chat|js\.driftt\.com|static\.zdassets\.com|cdn\.livechatinc\.com|code\.tidio\.co"
HREFLANG = r"""hreflang\s*=\s*["']([a-z]{2})(?:-[a-z0-9]{2,8})*["']"""
TRACKER_POINTS, TRACKER_MAX = 8, 30
CHAT_POINTS, LANGUAGE_POINTS, PAGES_POINTS, BRANCH_POINTS = 10, 8, 6, 6
MANY_PAGES, MANY_BRANCHES = 6, 5
HIGH_FROM, MEDIUM_FROM, JUDGED_FROM = 38, 22, 2000

# ---- fixed values: people ---------------------------------------------------
TITLE_TIERS = {
    "T1": r"\b(chairman|ceo|chief executive|founder|co-?founder|owner|proprietor|partner|managing director|managing partner|president|general manager|deputy general manager|g\.?m\.?)\b",
    "T2": r"\b(head of|director|vp|vice president|country director|medical director|project director|mlro|compliance officer|aml)\b",
    "T3": r"\b(manager|officer|lead|supervisor|practice manager|estimation|tender|meal)\b",
}
# ---- fixed values: sending --------------------------------------------------
RAMP = ((5, 8), (10, 12), (15, 15), (None, 18))
DAILY_MAX, WEEKLY_MAX = 20, 90
MESSAGE_RAMP = ((5, 8), (10, 12), (None, 20))
MESSAGE_DAILY_MAX, MESSAGE_WEEKLY_MAX = 20, 100
SAMPLE_SIZE = 100
PENDING_DAYS = 21

# ---- fixed values: mailboxes that are no person's ----------------------------
ROLE_MAILBOXES = (
    "info contact hello inquiries enquiries enquiry support admin office general careers career hr jobs recruit recruitment "
    "marketing press media pr comms sales bookings booking reservations reservation appointments appointment frontdesk reception "
    "manager operations banqueting catering events concierge no-reply noreply donotreply gm hd md ceo coo cfo cto dir director "
    "directors management owner founder boss head chief president principal shop store retail spa wellness restaurant bar kitchen "
    "housekeeping maintenance security groups accounts accounting finance billing invoice invoices webmaster web it helpdesk mail "
    "email post stay welcome hotel team service services customer customerservice guest guests front desk meetings direktion "
    "direktor geschaeftsfuehrung empfang buchung anfrage anfragen rezeption verwaltung direction accueil reservationsfr "
    "renseignements direzione prenotazioni ufficio informazioni ricevimento direccion reservas gerencia gerente recepcion recepce "
    "rezervace vedeni kancelar recepcja rezerwacje biuro receptie reserveringen kantoor igazgato recepcio foglalas iroda"
).split()
# ---- fixed values: names in addresses ----------------------------------------
NAME_PARTICLES = "de del della di da dos das van von der den ter le la el al bin ibn abu mac mc st san santa do du ten op".split()
NAME_PLACEHOLDERS = (
    "ihre ihr deine dein votre vos ton tuo tua su tu vuestro seu sua twoj vas vase din ditt jouw uw eposta epost correo courriel mailadresse adresse"
).split()
PLACEHOLDER_HOST = r"^(e?mail|domain|yourdomain|example|exemple|ejemplo|esempio|beispiel|sample|test|demo|placeholder|company|firma|site|website|inbox|xyz|abc)\."
PLACEHOLDER_PARTS = ("example", "yourname", "yourdomain", "j.doe", "johndoe", "janedoe", "placeholder", "@test.", "@domain.", "@sample.")
BUSINESS_WORDS = (
    "clinic", "clinics", "hospital", "polyclinic", "center", "centre", "group", "holding", "real estate", "properties", "restaurant",
    "cafe", "salon", "spa", "pharmacy", "dental", "medical", "law", "associates", "partners", "insurance", "studio", "academy",
    "hotel", "resort", "motors", "automotive", "lab", "laboratory",
)
# ---- fixed values: whose page a page is ----------------------------------------
IDENTITY_STOP = (
    "the and for center centre clinic clinics medical dental dentist hospital group company co llc ltd salon spa beauty hair real estate "
    "properties restaurant cafe auto car service services trading est establishment riyadh jeddah dubai doha beirut saudi arabia emirates "
    "uae qatar kuwait bahrain oman مركز مجمع عيادة عيادات طبي الطبي للاسنان الأسنان مستوصف شركة مؤسسة مطعم صالون"
).split()
AGGREGATORS = ("booking.com", "expedia.", "tripadvisor.", "hotels.com", "airbnb.", "agoda.", "trivago.", "facebook.com", "instagram.com")
# ---- fixed values: a profile's link in free text --------------------------------
PROFILE_LINK = r"(?i)https?://[^\s)>\]]*linkedin\.com/in/[^\s)>\]]+"
# ---- fixed values: countries' phone codes, and their mobile numbers as (prefix behind the code, digits in all) ----
PHONE_CODES = {"AE": "971", "SA": "966", "QA": "974", "BH": "973", "KW": "965", "LB": "961"}
MOBILE_RULES = {
    "LB": (("3", 10), ("70", 11), ("71", 11), ("76", 11), ("78", 11), ("79", 11), ("81", 11)),
    "AE": (("5", 12),),
    "SA": (("5", 12),),
    "QA": (("3", 11), ("5", 11), ("6", 11), ("7", 11)),
    "BH": (("3", 11),),
    "KW": (("5", 11), ("6", 11), ("9", 11)),
}
# ---- fixed values: countries in words -------------------------------------------
COUNTRY_NAMES = {
    "AE": "the UAE", "SA": "Saudi Arabia", "QA": "Qatar", "BH": "Bahrain", "KW": "Kuwait", "OM": "Oman", "LB": "Lebanon", "JO": "Jordan", "EG": "Egypt",
    "ES": "Spain", "IT": "Italy", "FR": "France", "MC": "Monaco", "PT": "Portugal", "GR": "Greece", "DE": "Germany", "AT": "Austria", "CH": "Switzerland",
    "NL": "the Netherlands", "BE": "Belgium", "LU": "Luxembourg", "CZ": "Czechia", "HU": "Hungary", "HR": "Croatia", "SI": "Slovenia", "ME": "Montenegro",
    "RS": "Serbia", "AL": "Albania", "MK": "North Macedonia", "BA": "Bosnia and Herzegovina", "TR": "Turkey", "DK": "Denmark", "SE": "Sweden", "NO": "Norway",
    "FI": "Finland", "IS": "Iceland", "IE": "Ireland", "GB": "the UK", "PL": "Poland", "RO": "Romania", "SK": "Slovakia", "BG": "Bulgaria", "MT": "Malta",
    "CY": "Cyprus", "EE": "Estonia", "LV": "Latvia", "LT": "Lithuania", "UA": "Ukraine", "MD": "Moldova", "US": "the US", "CA": "Canada", "MX": "Mexico",
    "BR": "Brazil", "AR": "Argentina", "CL": "Chile", "CO": "Colombia", "PE": "Peru", "AU": "Australia", "NZ": "New Zealand", "JP": "Japan",
    "KR": "South Korea", "CN": "China", "HK": "Hong Kong", "TW": "Taiwan", "SG": "Singapore", "MY": "Malaysia", "TH": "Thailand", "VN": "Vietnam",
    "PH": "the Philippines", "ID": "Indonesia", "IN": "India", "PK": "Pakistan", "BD": "Bangladesh", "LK": "Sri Lanka", "IL": "Israel", "ZA": "South Africa",
    "NG": "Nigeria", "KE": "Kenya", "MA": "Morocco", "TN": "Tunisia", "DZ": "Algeria",
}
# ---- fixed values: what a message may not say --------------------------------------
MONEY = (
    r"\$|(^|[^a-z0-9_])(price|pricing|priced|fee|fees|retainer|commission|monthly fee|per month|/month|cost|costs|free setup|no monthly|charge|charges|"
    r"dollar|dollars|usd|invoice|subscription)([^a-z0-9_]|$)"
)

# ---- fixed values: pages that name people, in order of preference, and lines of consent banners
PEOPLE_PAGES = (
    "leadership", "management", "team", "ourteam", "our-team", "about", "aboutus",
    "about-us", "people", "staff", "attorneys", "lawyers", "doctors", "physicians",
    "providers", "owners", "founders", "contact", "contactus", "contact-us",
)
BANNER = (
    r"cookie|consent|consentimiento|consenso|consentement|einwilligung|"
    r"pol[íi]tica de (cookies|privacidad)|privacy policy|informativa|"
    r"politique de confidentialit|datenschutz|"
    r"configuraci[óo]n|aceptar|rechazar|accept all|reject all|accetta|rifiuta|"
    r"accepter|refuser|akzeptieren|ablehnen|"
    r"utilizamos|utilizziamo|nous utilisons|wir verwenden|we use cookies|"
    r"navegaci[óo]n|manage preferences|gestionar preferencias|configurar|"
    r"recordar determinadas|preferencias del usuario|"
    r"t[ée]cnicas esenciales|anal[íi]ticas|publicitarias|personalizaci[óo]n necesari"
)
#: Parts of a page that show no text.
HIDDEN_TAGS = ("script", "style", "head", "noscript", "svg")
