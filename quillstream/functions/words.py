"""Words and patterns that the gates and section filters know. All of them are fixed values, over lower-cased text."""

from __future__ import annotations

# Asset classes. Patterns of deals other than industrial ones, and of industrial assets that outweigh them.
STRONG_ASSET = r"\b(warehouses?|industrial\s+(buildings?|parks?|outdoor\s+storage|space)|logistics\s+(centers?|facilit(?:y|ies)|hubs?)|distribution\s+centers?|fulfillment\s+centers?|manufacturing\s+facilit(?:y|ies)|cold\s+storage|truck\s+terminals?|cross[ -]?docks?|trailer\s+parking|loading\s+docks?|3pl|drayage|intermodal)\b"
OFFICE_DEAL = r"\b(office\s+(lease|space|building|tower|market)|class\s*a\s+office|headquarters\s+lease|hq\s+lease|coworking|medical\s+office|medical\s+for\s+(lease|sale)|takes?\s+\d[\d,]*[ -]?(sf|square\s*feet|sq\.?\s*ft)?\s+office|office\s+at\s+\d)\b"
OFFICE_LED = r"\b(?:office\s+footprint|office\s+(?:to|for)\s+(?:about\s+|nearly\s+|approximately\s+)?\d|office\s+expand(?:s|ed|ing|sion)?|office\s+lease\s+for|(?:at|to|into|within|inside)\s+(?:the\s+)?[\w'.,\- ]{0,40}?office\s+(?:development|building|tower|complex|campus|park))\b"
RESIDENTIAL_DEAL = r"\b(apartment|multifamily|condo(minium)?|residential\s+(building|tower|complex)|single[ -]family|townhome|student\s+housing|senior\s+living|assisted\s+living|homebuilding|homebuilder|home\s+builder)\b"
RETAIL_DEAL = r"\b(retail\s+(lease|space|center|building)|shopping\s+center|strip\s+mall|outlet\s+mall|restaurant\s+(lease|space)|storefront|showroom\s+lease|fashion\s+designer)\b"
HOSPITALITY_DEAL = r"\b(hotel\s+(lease|sale|deal|acquisition)|hospitality|resort|motel|airbnb|short[ -]term\s+rental)\b"
SELF_STORAGE = r"\b(self[ -]storage|storage\s+unit|climate[ -]controlled\s+storage)\b"
SOFTWARE_DEAL = r"\b(data\s+(platform|marketplace|company|provider|service|analytics)|software\s+(platform|company|provider|firm)|saas\s+(platform|company)|tech\s+(platform|startup|company)|proptech\s+(platform|startup|firm)|venture\s+round|series\s+[a-h]\s+(round|funding)|(nabs?|raises?|secures?|closes?|lands?)\s+\$\d[\d.,]*\s*(million|m\b|billion|b\b)\s+(to\s+(help|build|expand|launch|scale|compete|take\s+on)|in\s+(seed|series|funding|venture)|from\s+(investors?|vcs?))|api\s+platform|cloud\s+platform)\b"
MILITARY_PERSON = r"\b(seaman|petty\s+officer|sergeant|sgt\.?|corporal|lieutenant|captain\s+\w+\s+promoted|airman|sailor|marine\s+(corporal|sergeant|sgt\.?|lt\.?))\b"
RETAIL_PERSON = r"\b(target|walmart|amazon|kroger|albertsons|costco|whole\s+foods|trader\s+joe'?s|aldi|publix|wegmans|safeway|home\s+depot|lowe'?s|cvs|walgreens|rite\s+aid|7-eleven)\s+(taps?|hires?|names?|appoints?|elevates?|promotes?)\b"
WRONG_DEALS = [OFFICE_DEAL, RESIDENTIAL_DEAL, RETAIL_DEAL, HOSPITALITY_DEAL, SELF_STORAGE, SOFTWARE_DEAL, MILITARY_PERSON, RETAIL_PERSON]

# Detention as a use, and what the word means on a building site.
DETENTION_USE = r"\b(detainment|detainees?|immigrant\s+jail|immigration\s+detention|private\s+prisons?|correctional\s+facilit(?:y|ies)|inmates?|holding\s+facilit(?:y|ies))\b"
DETENTION = r"\bdetention\b"
DETENTION_OF_WATER = [r"\bdetention\s+(basin|pond|tank|vault|system|area)\b", r"\b(storm-?water|water|on-?site)\s+detention\b"]

# A property brought to market, and a deal that is done.
LISTING = r"\b(lists|markets|offers)\b(?:\s+(?:up|out|for\s+(?:sale|lease)))?\s+(?:a|an|the|its|new|\d[\d,]*(?:\.\d+)?(?:\s*(?:sf|k|acres?))?\s+)?(?:[\w.\-]+\s+){0,3}?(sites?|propert(?:y|ies)|buildings?|warehouses?|facilit(?:y|ies)|land|acreage|acres?|campus(?:es)?|complex(?:es)?|portfolios?|sq\.?\s*ft|square\s*feet|(?:industrial|logistics|distribution)\s+(?:buildings?|facilit(?:y|ies)|parks?|centers?|centres?|warehouses?|complex(?:es)?|campus(?:es)?|portfolios?))\b"
DEAL_DONE = r"\b(acquires?|acquired|sells?|sold|buys?|bought|purchas(?:es?|ed)|leased|signs?\s+(?:a\s+)?lease|inks?\s+(?:a\s+)?lease|finances?|financed|refinances?|closes?\s+(?:on|the\s+deal|deal)|closed|trades?|traded)\b"

# The steps of the industrial gate.
JUNK = r"\b(sloths?|animal (?:rescue|welfare|cruelty|shelter|sanctuary|abuse)|wildlife|\bzoo\b|menagerie|rescued animals?)\b"
PAGE_INDEX = r"[-–—]\s*page\s+\d+\b"
ASSET_NAMED = r"\b(warehouses?|logistics|distribution|fulfillment|manufacturing|cold\s+storage|industrial|flex\s+space|commercial\s+flex|industrial\s+flex|last[ -]?mile|cross[ -]?dock|loading\s+dock|truck\s+terminal|\bios\b|outdoor\s+storage)\b"
NOT_INDUSTRIAL = [
    "office lease", "office building", "office tower", "office space", "offices", "coworking", "co-working", "class a office", "class b office", "office campus", "office portfolio", "office property",
    "multifamily", "multi-family", "apartment", "residential", "condo", "condominium", "single-family", "single family", "townhouse", "townhome", "homebuilder", "home builder",
    "penthouse", "luxury home", "luxury condo", "luxury residence", "active adult", "55+", "55 and older", "age-restricted", "senior living", "assisted living", "nursing home", "memory care",
    "student housing", "dormitory", "retail", "restaurant", "shopping center", "mall", "strip mall", "outlet", "bookstore", "grocery store", "supermarket", "convenience store",
    "wine bar", "cocktail bar", "brewery", "taproom", "coffee shop", "cafe opens", "bank branch", "hotel", "hospitality", "resort", "motel", "airbnb", "self-storage", "self storage", "mini storage",
    "car dealer", "auto dealer", "car dealership", "auto dealership", "medical office", "medical center", "hospital", "cdmo", "contract development and manufacturing", "clinical-stage", "commercial-stage",
    "drug product", "pharmaceutical powder", "spray drying", "inhaled therapy", "nasal therapy", "probiotic", "clinical manufacturing", "gym ", "fitness center", "boxing gym", "yoga studio",
    "church", "religious", "museum", "library", "charter school", "public school", "bid-rigging", "pleads guilty", "guilty plea", "indicted", "sentenced", "foreclosure", "bankruptcy filing",
    "mixed-use residential", "mixed use residential", "mixed-use", "mixed use", "mansion", "estate sale", "penthouse sale", "townhouse sale", "lists for $", "compound built by", "macy's heir", "heir lists",
    "realtor", "social work", "university", "institute of technology", "college", "curriculum", "graduate-level", "master of science", "bioprocessing", "cell therapy", "gene therapy",
    "crisis response", "disaster relief", "humanitarian", "aid network", "nonprofit logistics", "charity", "food distribution", "food bank", "food pantry", "food drive", "community food",
    "snap benefit", "meal distribution", "feeding program", "bank debuts", "bank opens", "bank branch", "credit union", "industrial heir", "lakefront home", "waterfront home", "beachfront home",
    "polo field", "polo club", "golf course", "country club", "boardwalk", "pavilion", "community destination", "amusement", "convention center", "arena",
    "warehouse arts district", "warehouse district restaurant", "warehouse district bar",
]
KEPT_ANYWAY = ["warehouse", "logistics center", "distribution center", "fulfillment center", "manufacturing facility", "cold storage", "industrial park", "loading dock", "industrial outdoor storage", "flex space", "cross-dock", "commercial flex", "industrial flex", "flex/industrial", "flex building"]
CORE = [
    "industrial", "warehouse", "logistics", "distribution", "manufacturing", "cold storage", "last-mile", "last mile", "industrial outdoor storage", "fulfillment", "flex space", "spec industrial",
    "industrial park", "loading dock", "data center", "cross-dock", "cross dock", "build-to-suit", "vacancy rate", "commercial flex", "industrial flex", "flex/industrial", "flex building",
]
PROPERTY_SIGNAL = r"\b(warehouses?|leases?|sold|acquired|sq\.?\s*ft|square\s*feet|acres|propert(?:y|ies)|buildings?|facilit(?:y|ies)|sites?|developments?|tenants?|portfolios?|zoning|assets?|markets?|reports?|sectors?|demand|outlook|recovery|real\s*estate|investors?|investments?|rents?|cap\s*rate|occupancy|ops|operations|leaders|users|space)\b"
SUPPLY_CHAIN = ["supply chain", "freight", "trucking", "shipping", "cargo", "e-commerce", "ecommerce", "automation", "autonomous", "robotics"]
PHYSICAL_ASSET = r"\b(warehouses?|distribution\s+centers?|fulfillment\s+centers?|logistics\s+centers?|industrial\s+parks?|industrial\s+buildings?|manufacturing\s+facilit(?:y|ies)|cold\s+storage|3pl|drayage|intermodal|ports?|terminals?|rail\s+yards?|truck\s+terminals?|trailer\s+parking|last[ -]?mile\s+facilit(?:y|ies)|loading\s+docks?|cross[ -]?docks?|industrial\s+outdoor\s+storage|spec\s+industrial)\b"
MACRO = [
    "interest rate", "federal reserve", "fed ", "inflation", "capital markets", "cap rate", "noi", "vacancy", "absorption", "rent growth", "commercial real estate", "cre", "reit", "cmbs",
    "construction cost", "labor cost", "insurance cost", "reshoring", "nearshoring", "onshoring", "joint venture", "value-add", "value add", "adaptive reuse", "opportunity zone",
    "irr", "ltv", "loan-to-value", "valuation", "net operating income", "intermodal", "build-to-suit", "bts",
]
DEAL_SIGNALS = [
    "for lease", "for sale", "for sublease", "on the market", "acquisition", "acquired", "disposition", "sold", "purchased", "sale of", "square feet", "sq ft", "sq. ft", "acres",
    "zoning", "rezoning", "entitlement", "economic development", " eda ", "joint venture", "recapitalization", "sale-leaseback", "sale leaseback", "ground lease", "assemblage", "entitlements",
]
PROPERTY_CONTEXT = r"\b(warehouses?|industrials?|distribution|logistics|fulfillment|manufacturing|cold\s+storage|buildings?|facilit(?:y|ies)|propert(?:y|ies)|portfolios?|assets?|sites?|acres|square\s+feet|sq\.?\s*ft|\bsf\b|land\s+(sale|deal)|industrial\s+parks?|centers?|complex(?:es)?|campus(?:es)?|loading\s+docks?)\b"
VEHICLE_AD = r"\b(pickup|sedan|suv|truck\s+for\s+sale|dealership|2024|2025\s+(ford|chevy|toyota|honda|ram)|crew\s+cab|king\s+cab|4x4|safety\s*&\s*comfort|test\s+drive|learn\s+more\s*\))\b"
LEASE_WORDS = ["leasing", "lease", "tenant", "landlord"]
LEASE_CONTEXT = r"\b(warehouses?|industrials?|logistics|distribution|manufacturing|fulfillment|cold\s*storage|flex\s*space|commercial\s*real\s*estate|cre)\b"
LAND_SIGNAL = r"\b(sq\.?\s*ft|square feet|acres)\b"
FIRMS = ["newmark", "jll", "cbre", "cushman", "colliers", "blackstone", "prologis", "bridge industrial", "nai ", "naiop", "sior", "ccim", "costar", "avison young", "marcus & millichap", "eastdil", "walker & dunlop", "berkadia"]
ROLES = ["brokerage", "broker", "development", "redevelopment", "developer", "portfolio", "asset", "property", "vice president", "managing director", "principal"]

# Section filters.
POLITICAL = [
    "trump", "biden", "president elect", "congress", "senate", "election", "political", "white house", "democrat", "republican", "governor", "legislation", "tariff", "border", "immigration", "gop",
    "executive order", "administration", "campaign", "ballot", "voting", "supreme court", "cabinet", "impeach", "partisan", "bipartisan", "elon musk", "musk", "spacex", "doge", "jeff bezos",
    "mark zuckerberg", "zuckerberg", "bill gates", "shutdown", "debt ceiling", "stimulus", "government spending", "foreign policy", "military", "defense budget", "pentagon", "nato", "sanctions", "diplomatic",
    "iran conflict", "israel-iran", "iran-israel", "gaza conflict", "ukraine war", "russia-ukraine", "middle east conflict", "taiwan conflict", "china conflict", "north korea", "war in ", "consequences of war",
    "consequences of conflict", "geopolitical conflict", "armed conflict", "killed", "dead", "injured", "crash", "collapsed", "collapse", "explosion", "helicopter", "shooting", "homicide", "murder", "arson",
    "fire kills", "trapped", "fatal", "died",
]
RELEVANT = [
    "interest rate", "fed ", "federal reserve", "inflation", "cpi", "lending", "financing", "capital markets", "freight", "shipping", "trucking", "supply chain", "port", "cargo", "container",
    "construction cost", "material cost", "steel", "concrete", "lumber", "labor cost", "labor market", "insurance", "insurance cost", "property insurance", "industrial", "warehouse", "distribution",
    "fulfillment", "cold storage", "logistics", "flex space", "manufacturing", "last mile", "e-commerce", "spec development", "industrial park", "approved", "approves", "approval", "zoning", "rezoning",
    "entitlement", "permits", "planning board", "groundbreaking", "under construction", "development", "project", "proposed", "planned", "sustainable industrial", "esg property", "net zero", "green building",
    "leed", "last mile delivery", "automation", "robotics", "automated warehouse", "workforce development", "skilled trades", "labor shortage", "reshoring", "nearshoring", "supply chain resilience", "onshoring",
    "data center", "flex warehouse", "cross-dock", "cross dock", "last-mile facility", "micro-fulfillment", "micro fulfillment", "agri-tech", "agritech", "food processing", "food facility",
    "advanced manufacturing", "contract manufacturing", "commercial real estate", "cre", "vacancy", "absorption", "rent growth", "cap rate", "leasing", "acquisition", "investment", "tenant", "brokerage",
    "site selection", "flex", "facility", "intermodal", "build-to-suit", "redevelopment", "clear height", "reit", "value-add", "pipeline", "opportunity zone", "expansion", "adaptive reuse", "irr",
    "loan-to-value", "ltv", "valuation", "joint venture", "yield", "noi", "net operating income", "e-commerce growth", "e-commerce trends",
]
DEAL_ACTIONS = [
    "acquired", "acquisition", "purchased", "purchase", "sold", "sale of", "sells", "leased", "lease", "signed", "closes", "closed", "financing", "refinanc", "arranges", "arranged", "brokered", "negotiated",
    "completed", "bought", "buying", "invested", "investment in", "joint venture", "recapitalization", "disposition", "capitalization",
]
AVAILABLE = [
    "available", "for sale", "for lease", "listing", "on the market", "seeking buyer", "buyer wanted", "now leasing", "now available", "seeking tenants", "for sublease", "sublease", "space available",
    "build-to-suit", "vacant", "vacancy", "delivered", "spec", "under construction", "breaks ground", "groundbreaking", "coming to market",
]
PEOPLE_ACTIONS = [
    "hired", "appointed", "promoted", "joined", "named", "elevated", "tapped", "recruit", "hires", "appoints", "promotes", "names", "adds", "taps", "leads", "heads", "chair", "nabs", "welcomes", "brings",
    "movers", "shakers", "leadership", "executive", "move", "announces", "announced", "selected", "recognized", "award", "honored", "featured", "profile", "spotlight", "interview", "q&a", "power broker",
    "rising star", "top producer",
]
OF_COMPANIES_TOO = ["award", "awarded", "selected", "recognized", "honored", "announces", "announced"]
PERSON_ROLES = [
    "ceo", "cfo", "coo", "cio", "cto", "president", "chairman", "chairwoman", "vice president", "vp ", "svp ", "evp ", "managing director", "director", "principal", "partner", "executive", "officer",
    "broker", "head of", "chief", "senior advisor", "board of directors", "board member", "to board", "advisory board",
]
PERSON_TITLE = r"\b(hired|appointed|promoted|named|joins|joined|taps|welcomes|hires|appoints|promotes|names|recruits|elevates?|elevated)\b"
PEOPLE_TITLE = r"\b(hired|appointed|promoted|named|joins|joined|taps|welcomes|hires|appoints|promotes|names)\b"
PEOPLE_BODY = ["hired", "appointed", "promoted", "joined", "named", "elevated", "tapped"]
RESCUE_TITLE = r"\b(hires?|hired|appoints?|appointed|promotes?|promoted|names?|named|joins?|joined|taps?|tapped|welcomes?|recruits?)\b"
AGENCY_TOKEN = r"\beda\b"
INDUSTRY_NAMES = [
    "nai", "sior", "ccim", "cbre", "jll", "cushman", "colliers", "newmark", "marcus", "millichap", "prologis", "duke", "link logistics", "rexford", "first industrial", "stag", "terreno", "exeter", "blackstone",
    "brookfield", "clarion", "dermody", "hillwood", "idl", "panattoni", "avison young", "lee & associates", "kidder mathews", "transwestern", "savills", "ngkf", "eastdil", "hff", "walker & dunlop", "berkadia",
    "northmarq", "keane", "ware malcomb", "industrial", "logistics", "warehouse", "distribution", "fulfillment", "cold storage", "commercial real estate", "cre", "investment sales", "capital markets", "brokerage",
    "real estate", "development", "developer", "redevelopment", "land use", "zoning", "property", "portfolio", "asset", "partner", "principal", "managing director", "vice president", "broker", "leasing",
    "acquisition", "construction", "economic development", "naiop", "icsc", "uli", "boma", "cbre institute", "investor", "fund manager", "private equity", "institutional", "family office", "reit",
    "investment firm", "investment manager", "allocation", "fundraising", "capital raise",
]
NOT_FOR_PEOPLE = ["residential broker", "elliman", "compass real", "redfin", "zillow", "mortgage lender", "retail broker", "multifamily broker", "apartment complex", "hotel broker", "hospitality"]

# Data centres.
DATA_CENTRE = r"\bdata\s?cent(?:er|re)s?\b"
CENTRE_PROJECT = r"\b(build|builds|building|to build|construct(?:s|ing|ion)?|develop(?:s|ing|ed|ment)?|break(?:s|ing)?\s+ground|groundbreak\w*|plan(?:s|ned|ning)?|propos(?:e|es|ed|al|ing)|campus|facility|complex|\bproject\b|slated|underway|targets?|opening|opens?|delivers?|\bsite\b|acres?\b)\b"
CENTRE_MARKET = r"\b(market|boom|demand|vacancy|absorption|outlook|trend|forecast|sector|financ\w*|\bfund\b|venture|\breit\b|\bspac\b|\bipo\b|go(?:es|ing)?\s+public|valuation|\bmerger\b|courting buyers|policy|regulat\w*|ordinance|zoning|moratori\w*|\bpaus\w*|\bban\b|legislat\w*|lawmaker|\bbill\b|tax credit|\bgrid\b|power\s+(?:cost|price|market|demand|use)|electric|utilit\w*|interconnect\w*|analysis|analyst|\bstudy\b|survey|emerging|to watch|\bskips?\b|hysteria|debate)\b"
CENTRE_POLICY = r"\b(ban(?:s|ned|ning)?|moratori\w*|\bpaus\w*|zoning|ordinance|tax\s+credit|incentive|legislat\w*|lawmaker|\bbill\b|\bact\b|assembly|house of representatives|\bsenate\b|city council|committee|commission|board\b|denies|denied|rejects?|rejected|\bvotes?\b|approv\w*|repeal|regulat\w*|restrict\w*|opposition|protest|rally|lawsuit|sues?|sued|\bjudge\b|\bcourt\b|confidentiality|transparency|secures?\s+\$|financ\w*|\bfund\b|loan\w*|\bstock\b|\bshares\b|\bipo\b|\bspac\b|valuation|\bmerger\b|acquir\w*|lease\s+deal|closes?\s+\$|series\s+[a-d]\b|brokers?\s+sale|sale\s+of|surges?|jumps?|grapple|limits?\b|nix\w*|end(?:s|ing)?\s+.*tax|\bbanks?\b|\blenders?\b|wall street|nonperforming|debt maturit|loss reserves|earnings)\b"

# Geography of titles.
AGENCY = r"\b(?:industrial|economic)\s+development\s+(?:agency|authority|commission|council|board|corporation|district)\b"
CATALOGUE = r"\s+[-–—|]\s+(?:commercialsearch|loopnet|propertyshark|traded\.co|crexi)\s*$"
CATALOGUE_START = r"^(?:for\s+lease|for\s+sale)\s*\|"
BUYS = r"\b(?:buys|bought|buying|acquires?|acquired|acquiring|purchas(?:es|ed|ing)|snaps?\s+up|snapped\s+up|picks?\s+up|picked\s+up|scoops?\s+up|scooped\s+up|nabs?|nabbed|grabs?|grabbed)\b"

# Links and sources.
REFUSED_LINK = r"utm_|redirect|cache|preview|bing\.com|fbclid|gclid|mc_cid|mc_eid"
LEFT_AS_IS = ["redirect", "cache", "tracking", "proxy"]
LIGHTLY_FILTERED = [
    "realestatenj", "real estate nj", "commercialsearch", "commercial search", "wsj", "wall street journal", "bisnow", "globest", "naiop", "cpexecutive", "commercial property executive", "cpe",
    "bizjournals", "business journal", "loopnet", "loop net", "costar", "lehighvalley", "lehigh valley", "lvb", "dailyrecord", "daily record", "njbiz",
]
OFF_TOPIC = r"\b(sports?|game|score|team|player|celebrity|movie|tv show|recipe|horoscope)\b"
ON_TOPIC = r"industrial|warehouse|logistics|distribution|manufacturing|real estate|commercial|property|lease|office|retail|development|investment|tenant|landlord|market|construction|acquisition"

# Descriptions that say nothing.
EMPTY_TALK = [
    "no specific information", "please provide", "i cannot", "i don't have", "not enough information", "unable to summarize", "no article details", "no details provided", "insufficient information",
    "source is unknown", "no summary available", "summary unavailable", "not available", "no information available", "cannot determine", "no details available", "based on the title alone",
    "without more context", "without additional details", "the article appears to", "no specific commercial real estate", "no specific deal", "no specific transaction", "is mentioned in the title",
    "mentioned in the title or description", "a general trend is implied", "trend is implied", "the title or description", "no specific real estate",
]

# The rule engine. Sources that it takes, its keywords in order, places of the market and beyond.
ENGINE_SOURCES = [
    "news.google.com", "re-nj.com", "commercialsearch.com", "wsj.com", "bisnow.com", "globest.com", "naiop.org", "cpexecutive.com", "bizjournals.com", "loopnet.com", "costar.com", "lvb.com",
    "dailyrecord.com", "njbiz.com", "connectcre.com", "credaily.com", "therealdeal.com", "freightwaves.com", "supplychaindive.com", "bloomberg.com", "reuters.com", "apnews.com", "cbre.com",
    "jll.com", "cushwake.com", "colliers.com", "traded.co", "areadevelopment.com", "inboundlogistics.com", "naikeystone.com", "naiplatform.com", "rebusinessonline.com", "commercialcafe.com",
    "commercialobserver.com", "rejournals.com", "dcvelocity.com", "ttnews.com", "constructiondive.com", "prologis.com", "prnewswire.com", "globenewswire.com", "businesswire.com", "connect.media",
    "roi-nj.com", "njspotlightnews.org", "logisticsviewpoints.com", "joc.com", "retaildive.com", "sior.com",
]
ENGINE_INDUSTRIAL = [
    "industrial", "warehouse", "distribution", "logistics", "fulfillment", "supply chain", "cold storage", "manufacturing", "last-mile", "last mile", "truck terminal", "cross-dock", "cross dock",
    "flex industrial", "flex space", "ios", "industrial outdoor storage", "trailer parking", "dock doors", "loading dock", "clear height", "warehouse space", "distribution center",
    "fulfillment center", "logistics center", "industrial park", "spec industrial", "intermodal", "drayage", "3pl", "data center",
]
ENGINE_INTENT = [
    "real estate", "lease", "leasing", "cre", "acquisition", "development", "property", "commercial", "investment", "tenant", "brokerage", "site selection", "flex", "facility", "intermodal",
    "build-to-suit", "entitlement", "zoning", "redevelopment", "clear height", "reit", "value-add", "pipeline", "opportunity zone", "supply chain", "expansion", "adaptive reuse", "irr",
    "loan-to-value", "ltv", "valuation", "joint venture", "yield", "noi", "net operating income",
]
ENGINE_EXCLUDED = [
    "residential", "apartment", "condo", "single family", "hotel", "multifamily", "homebuilder", "hospitality", "self-storage", "self storage", "office building", "office lease", "office space",
    "class a office", "retail center", "shopping center", "strip mall", "outlet mall", "trump", "biden", "president trump", "president biden", "white house", "congress", "senate", "republican",
    "democrat", "political", "election", "executive order", "administration", "tariff war", "trade war", "governor", "legislation", "campaign", "ballot", "voting", "gop", "supreme court", "cabinet",
    "impeach", "partisan", "bipartisan", "shutdown", "debt ceiling", "stimulus", "government spending", "foreign policy", "military", "defense budget", "pentagon", "nato", "sanctions", "diplomatic",
    "elon musk", "musk", "spacex", "doge", "jeff bezos", "mark zuckerberg", "zuckerberg", "bill gates", "india", "china", "uk", "europe", "asia", "mexico", "canada", "london", "beijing", "shanghai",
    "mumbai", "delhi", "tokyo", "hong kong", "singapore", "dubai", "australia", "germany", "france", "stock price", "earnings report", "quarterly earnings", "ipo", "cryptocurrency", "bitcoin",
    "crypto", "nft", "layoffs", "job cuts", "workforce reduction", "super bowl", "world series", "playoffs", "championship", "movie", "film", "streaming", "netflix", "disney", "black friday",
    "cyber monday", "holiday shopping", "consumer spending",
]
MARKET_PLACES = [
    "new jersey", "nj", "pennsylvania", "pa", "florida", "fl", "port newark", "elizabeth", "newark", "jersey city", "bayonne", "trenton", "camden", "princeton", "morris county", "bergen county",
    "hudson county", "essex county", "middlesex county", "union county", "monmouth county", "somerset county", "central jersey", "north jersey", "south jersey", "shore", "philadelphia", "pittsburgh",
    "lehigh valley", "allentown", "bethlehem", "easton", "bucks county", "montgomery county", "chester county", "delaware county", "miami", "tampa", "orlando", "jacksonville", "fort lauderdale",
    "west palm", "palm beach", "fort myers", "naples", "south florida", "gold coast", "treasure coast", "space coast", "miami-dade", "broward", "hillsborough", "duval",
]
OTHER_MARKETS = [
    "texas", "houston", "dallas", "austin", "san antonio", "fort worth", "dfw", "dallas-fort worth", "plano", "irving", "arlington", "california", "los angeles", "san francisco", "bay area",
    "silicon valley", "san diego", "sacramento", "seattle", "portland", "denver", "phoenix", "las vegas", "salt lake", "boise", "tucson", "albuquerque", "chicago", "detroit", "minneapolis",
    "st. louis", "kansas city", "columbus", "indianapolis", "milwaukee", "cincinnati", "cleveland", "atlanta", "nashville", "charlotte", "raleigh", "richmond", "memphis", "birmingham", "charleston",
    "new orleans", "boston", "connecticut", "massachusetts", "baltimore", "maryland", "virginia", "washington dc", "washington, dc", "washington, d.c.", "d.c.", "el segundo", "rancho dominguez",
    "rancho cucamonga", "perris", "hesperia", "caddo parish", "shreveport", "louisiana", "niles, il", "niles, ohio", "costa mesa", "pinellas park", "soho", "midtown manhattan", "tribeca", "suffern",
    "westchester county", "tustin", "irvine", "anaheim", "santa ana", "long beach", "oakland", "fremont", "san jose",
]
ENGINE_OVERRIDES = ["github.com", "github.io"]
ENGINE_AVAILABLE = ["for sale", "for lease", "available", "listing", "on the market", "now available", "space available"]
ENGINE_PEOPLE = [
    "appointed", "named", "joined", "hired", "promoted", "executive", "ceo", "president", "taps", "nabs", "welcomes", "adds", "brings on", "recruits", "partner", "vice president",
    "managing director", "director", "chairman", "board", "leadership", "movers", "shakers",
]
ENGINE_BROKERS = ["nai", "cbre", "jll", "cushman", "colliers", "newmark", "marcus", "millichap", "sior", "ccim"]
ENGINE_INVESTORS = ["investor", "buys", "buyer", "acquires", "sells", "seller", "portfolio"]
ENGINE_DEALS = [
    "sells", "sold", "acquires", "acquired", "lease", "leased", "leases", "sale", "transaction", "closes on", "closed deal", "signs", "signed", "deal", "tenant", "occupies", "moves into", "relocates",
]
ENGINE_OTHER_TRADE = ["stock", "shares", "software", "technology", "retail sales", "consumer spending", "revenue", "earnings"]
ENGINE_PRICES = [r"\$[\d.,]+(?:million|m|billion|b|k|thousand)", r"\d+(?:\s*million|\s*billion|\s*thousand|\s*k)"]
ENGINE_SIZES = [r"\d+(?:,\d+)*\s*(?:sf|sq\.?ft|square\s*feet|sqft)", r"\d+(?:\.\d+)?\s*(?:acre|acres)"]

# The gate of the build.
BUILD_INDUSTRIAL = [
    "industrial", "warehouse", "logistics", "distribution", "manufacturing", "cold storage", "last-mile", "last mile", "industrial outdoor storage", "ios", "industrial land", "fulfillment",
    "flex space", "spec industrial", "industrial park", "loading dock", "supply chain", "freight", "trucking", "shipping", "cargo", "e-commerce", "ecommerce", "automation", "robotics", "data center",
    "cross-dock", "cross dock", "build-to-suit", "vacancy rate",
]
BUILD_REGIONAL = [
    "re-nj.com", "njbiz.com", "lvb.com", "bisnow.com/new-jersey", "bisnow.com/philadelphia", "bisnow.com/south-florida", "therealdeal.com/miami",
]
BUILD_REGIONAL_CLOSE = ["re-nj.com", "njbiz.com", "roi-nj.com"]
BUILD_PREFERRED = ["globest.com", "naiopnj.org", "naioppa.org", "connect.media", "bisnow.com", "re-nj.com"]
BUILD_VIDEO = r"/videos?/|\.mp4$|video\.foxbusiness|video\.cnbc"
BUILD_CATALOGUE = r"\s+[-–—|]\s+(?:loopnet|propertyshark|commercialsearch|crexi|traded\.co|dvids)\s*$"
BUILD_LOW_SIGNAL = r"supplychainbrain\.com/articles|dvidshub\.net|\bdvids\.net|defense\.gov|\baf\.mil|\barmy\.mil|\bnavy\.mil"
BUILD_TARGET = (
    r"\b(N\.?J\.?|NEW\s+JERSEY|P\.?A\.?|PENNSYLVANIA|PHILADELPHIA|F\.?L\.?|FLORIDA|MIAMI|TAMPA|ORLANDO|JACKSONVILLE|NEWARK|JERSEY\s+CITY|EDISON|ELIZABETH|TRENTON|RAHWAY|ALLENTOWN|BETHLEHEM|"
    r"LEHIGH\s+VALLEY|HOBOKEN|MEADOWLANDS|FORT\s+LAUDERDALE|MIAMI-DADE|BROWARD\s+COUNTY|PALM\s+BEACH|BERGEN\s+COUNTY|HUDSON\s+COUNTY|MIDDLESEX\s+COUNTY|MONMOUTH\s+COUNTY|OCEAN\s+COUNTY|"
    r"MERCER\s+COUNTY|SOMERSET\s+COUNTY|ESSEX\s+COUNTY)\b"
)
BUILD_PEOPLE = r"\b(WELCOMES|JOINS|APPOINTED|PROMOTED|HIRED|NEW HIRE|TAPS|RECRUITS|ELEVATED|MARKS MILESTONE|ANNIVERSARY)\b"
BUILD_REGIONAL_CONTEXT = r"\b(COMMERCIAL|REAL ESTATE|CRE|LEASE|SOLD|ACQUIRED|DEVELOPMENT|CONSTRUCTION|TENANT|BROKER|REIT|PORTFOLIO|TRANSACTION|SQUARE FEET|SF\b|ACRE)\b"
BUILD_PREFERRED_CONTEXT = (
    r"\b(COMMERCIAL REAL ESTATE|CRE|LEASE|SOLD|ACQUIRED|DEVELOPMENT|CONSTRUCTION|TENANT|REIT|PORTFOLIO|TRANSACTION|SQUARE FEET|INTEREST RATE|INFLATION|FREIGHT|SUPPLY CHAIN|CAP RATE|FOR SALE|"
    r"FOR LEASE|ACQUISITION|DISPOSITION)\b"
)
BUILD_STRONG = r"\b(COMMERCIAL REAL ESTATE|CRE|REIT|CAP RATE|NOI|SQUARE FEET|MILLION SF|FOR LEASE|FOR SALE|ACQUISITION|DISPOSITION|BUILD-TO-SUIT|GROUND-UP|SPEC DEVELOPMENT)\b"

# Categories given anew. Titles of index pages, and what texts and titles say.
INDEX_PAGE = r"^\s*(tag|category|archive|topic|author)\s*:"
ROUNDUP = r"top\s+industrial\s+leases\s+recognized\s+for\b"
STUBS = ["industrial"]
CRE_CONTEXT = r"\b(warehouses?|logistics|industrials?|distribution(?:\s*centers?)?|manufacturing|cold\s*storage|fulfillment|flex\s*space|commercial\s*real\s*estate|cre|reits?|portfolios?)\b"
STILL_INDUSTRIAL = r"\b(warehouses?|industrials?|logistics|distribution|manufacturing|cold\s*storage|fulfillment)\b"
DOLLARS = [r"\$[\d,]+", r"\d+\s*(million|m)\b"]
SQUARE_FEET = r"\d+[,\d]*\s*(sf|sq\.?\s*ft|square\s*feet)"
TRADED = (
    r"\b(purchased|purchases?|acquires?d?|bought|buys?|signs?\s*lease|leases?d?|closed|closes|sale\s*of|sells|sold\s*(to|for)?|acquisition|disposition|refinanc|takes?\s*\d|snags?|nabs?|lands?|inks?|"
    r"brokers?\s*sale|arranges?\s*sale|manages?\s*sale|secures?|scores?)"
)
ON_OFFER = r"\b(available|listed|for\s*lease|for\s*sale|on\s*the\s*market|ground-?up|spec|build-?to-?suit|under\s*construction|breaks\s*ground|groundbreaking|delivers|delivered)\b"
SOME_PROPERTY = r"\b(warehouses?|industrials?|distribution|logistics|buildings?|facilit(?:y|ies)|propert(?:y|ies)|centers?|parks?|sites?|acres|square\s*feet|sf|sq\.?\s*ft|space|campus(?:es)?|complex(?:es)?|portfolios?)\b"
MOVED = r"\b(promoted|hired|new\s*hire|joins|joined|named|appoints|appointed|taps|welcomes|recruits|elevated)\b"
PROFILE = (
    r"(\w+['’]s\s+\w+\s+on\s+\w|\w+\s+on\s+breaking\s+into|q\s*&\s*a\s+with|interview\s+with|in\s+conversation\s+with|women\s+of\s+influence|head\s+of\s+\w+.*answers|"
    r"vice\s+president.*\b(answers|shares|discusses|explains))"
)
FIRM_NAMED = (
    r"\b(brokerage|broker|development|developer|real estate|industrial|cre|reit|logistics|warehouse|nai|cbre|jll|cushman|colliers|newmark|prologis|blackstone|bridge industrial|locus\s*robotics|sagard|"
    r"woodmont)\b"
)
LISTING_SITE = r"\bloopnet\b"
MARKETED = (
    r"\b(for\s*lease|for\s*sale|now\s*leasing|now\s*available|seeking\s*tenants|available\s*for\s*lease|available\s*for\s*sale|for\s*sublease|on\s*the\s*market|space\s*available|build-?to-?suit|vacant)\b"
)
COMPLETED = r"\b(sold|acquired|bought|purchased|leased|closed|signed|inked|secured|landed)\b"
TITLE_MARKETED = (
    r"\b(for\s*lease|for\s*sale|now\s*leasing|now\s*available|for\s*sublease|on\s*the\s*market|space\s*available|vacant|delivers|delivered|breaks\s*ground|groundbreaking|under\s*construction)\b"
)
NEW_SUPPLY = (
    r"\b(breaks\s*ground|groundbreaking|under\s*construction|starts?\s*work|starts?\s*construction|delivers|delivered|spec\s*(industrial|warehouse|building|development)|"
    r"plans\s*(to\s*build|construction|development|facility|warehouse|logistics|distribution)|proposed\s*(warehouse|industrial|logistics|distribution)|"
    r"new\s*(warehouse|industrial|logistics|distribution)\s*(facility|building|center|park|development))\b"
)
TITLE_MOVED = r"\b(hired|appointed|promoted|named|joins|joined|taps|welcomes|hires|appoints|promotes|names)\b"

# The last gates before a send, over lower-cased text.
FINAL_TARGET = (
    r"\b(new jersey|nj|newark|edison|carlstadt|rahway|piscataway|parsippany|robbinsville|hamilton|monmouth|somerset|harrison|wall twp|north bergen|garwood|linden|moonachie|cranbury|"
    r"green brook|clark|freehold|trenton|camden|woodbridge|elizabeth|paterson|lakewood|mount olive|mt olive|mt laurel|mount laurel|middlesex|essex|union county|bergen|hudson county|"
    r"morris county|burlington county|ocean county|exit \d|meadowlands|turnpike|route 1|i-95|i-78|i-287|pennsylvania|philadelphia|philly|allentown|lehigh|morrisville|bucks county|"
    r"montgomery county|chester county|delaware county|pittsburgh|reading|lancaster|harrisburg|carlisle|wilkes.?barre|scranton|york county|bethlehem|easton|exton|king of prussia|valley forge|"
    r"cumberland county|berks county|florida|miami|orlando|doral|jacksonville|tampa|broward|pompano|hialeah|medley|fort lauderdale|palm beach|miami-dade|duval|hillsborough|orange county, fl|"
    r"fort myers|ft\.?\s*myers|naples|sarasota|lakeland|ocala|st\.?\s*petersburg|saint petersburg|gainesville|tallahassee|pensacola|polk county|pasco county|lee county|collier county|alachua|"
    r"seminole county|brevard|volusia|northeast industrial|north east industrial)\b"
)
FINAL_MACRO = (
    r"\b(interest rates?|cap rates?|vacancy rates?|absorption|industrial market|warehouse market|warehouse demand|logistics market|reit|industrial reit|supply chain|freight market|e-commerce|"
    r"automation|robotics|build-to-suit|spec development|industrial outlook|market report|quarterly report|national industrial|us industrial|u\.s\. industrial|industrial sector|"
    r"logistics sector|warehouse sector|industrial fund|industrial portfolio|industrial real estate|warehouse real estate|big.?box|shallow.?bay|last.?mile|cold storage market)\b"
)
SCRUB_TARGET = (
    r"\b(n\.?j\.?|new jersey|pennsylvania|\bpa\b|\bfl\b|florida|newark|jersey city|edison|piscataway|kearny|trenton|camden|woodbridge|middlesex|bergen|philadelphia|philly|allentown|lehigh|"
    r"bethlehem|pittsburgh|harrisburg|lancaster|king of prussia|miami|doral|hialeah|tampa|clearwater|orlando|jacksonville|fort lauderdale|pompano|west palm|palm beach|fort myers|"
    r"ft\.?\s*myers|naples|sarasota|lakeland)\b"
)
FINAL_TRUSTED = [
    "re-nj.com", "roi-nj.com", "bisnow.com", "globest.com", "commercialsearch.com", "commercialobserver.com", "connectcre.com", "credaily.com", "supplychaindive.com", "freightwaves.com", "blog.naiop.org",
    "commercialcafe.com", "areadevelopment.com", "rejournals.com", "ir.prologis.com", "lvb.com", "njbiz.com", "dcvelocity.com", "logisticsmgmt.com", "cpexecutive.com",
]
FINAL_SUFFIX = (
    r"(?i)\s*[-–—|]\s*(CoStar|GlobeSt|MSN|Yahoo|Bisnow|CommercialSearch|REBusinessOnline|Connect CRE|The Business Journals|Commercial Observer|Supply Chain Dive|FreightWaves|Real Estate NJ|WSJ|Law360|"
    r"LoopNet|AD HOC NEWS).*$"
)
SCRUB_EMPTY_TALK = [
    "no specific commercial real estate", "is mentioned in the title", "mentioned in the title or description", "a general trend is implied", "trend is implied", "the title or description", "no specific deal",
    "no specific transaction", "no specific real estate",
]
SCRUB_JUNK = r"\b(sloths?|wildlife|\bzoo\b|menagerie|animal (?:rescue|welfare|cruelty|shelter))\b"
SCRUB_CLIP = r"^\s*(watch|video|listen|podcast|webinar|live)\b[:\s]"
SCRUB_STUDENTS = r"\b(students?\s+(named|win|compete|awarded)|named winners?|wins?\s+.*competition|university announces|student competition)\b"
SCRUB_CHARITY = (
    r"\b(charit(?:y|ies|able)|humanitarian|food ?bank|toy drive|coat drive|donation drive|relief (?:effort|drive|mission|supplies)|fundrais(?:er|ing)|soup kitchen|homeless shelter|"
    r"helping (?:venezuela|ukraine|haiti|gaza|families|victims|the poor|the needy|the community))\b"
)
SCRUB_NONPROFIT = r"\bnon-?profit\b"
SCRUB_GIVING = r"\b(visit|donat|relief|charit|distribut|volunteer|drive)\b"

# News of people found in other sections.
STRONG_PEOPLE_ACTIONS = [
    "hired", "appointed", "promoted", "joined", "named", "elevated", "tapped", "hires", "appoints", "promotes", "names", "movers", "shakers", "power broker", "rising star", "top producer", "recognized",
    "award", "honored", "featured", "profile", "spotlight", "milestone", "anniversary", "marks milestone", "retirement", "retiring",
]
PEOPLE_PUFF = ["milestone", "anniversary", "retirement", "retiring", "marks milestone"]
