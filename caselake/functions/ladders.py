"""Rule lists of the case-record domain, as data for the functions in :mod:`.rules`."""

from __future__ import annotations

# Address patterns of document portals, first match wins.
URL_SIGNATURES = [
    ("publisher", r"/publisher/mvc/"),
    ("necs_assure", r"/(?:LP)?Assure/ES/Presentation/Planning/"),
    ("necs_assure", r"/NECSWS/ES/Presentation/Planning/"),
    ("necs_assure", r"/Northgate/ES/Presentation/Planning/"),
    ("northgate", r"/PublicAccess_LIVE/"),
    ("northgate", r"/AniteIM\.WebSearch/"),
    ("northgate", r"ExternalEntryPoint\.aspx"),
    ("northgate", r"/HPRMWebDrawer/"),
    ("northgate", r"/CMWebDrawer/"),
    ("northgate", r"/northgate/documentexplorer/"),
    ("idox", r"/online-applications/"),
    ("idox", r"/applicationDetails\.do"),
    ("agile", r"planning\.agileapplications\.co\.uk/"),
    ("arcus", r"/pr/s/register-view\?[^ ]*c__r=Arcus_BE"),
    ("arcus", r"/pr\d+/s/register-view\?[^ ]*c__r=Arcus_BE"),
    ("planning_register", r"planning-register\.co\.uk/"),
    ("civica_w2", r"/Planning/Display/"),
    ("herefordshire_direct", r"herefordshire\.gov\.uk/.*/planning_application_search/details"),
    ("elmbridge_emaps", r"emaps\.elmbridge\.gov\.uk/ebc_planning\.aspx.*PlanningPlansAndDocsTab"),
    ("peak_district", r"portal\.peakdistrict\.gov\.uk/result/"),
    ("kirklees_direct", r"kirklees\.gov\.uk/.*/search-for-planning-applications/detail\.aspx"),
    ("planning_docs", r"/planning/planning-documents\?"),
    ("planning_docs", r"/planning/documents\?"),
    ("planning_docs", r"/planningdocuments\?"),
    ("planning_docs", r"/forms/planning/planning-documents"),
    ("guernsey_direct", r"buildingexplorer\.gov\.gg/Northgate/Images/"),
    ("guernsey_direct", r"planningexplorer\.gov\.gg/portal/servlets/ApplicationSearchServlet"),
    ("shale_dialog", r"shale\.dialog\.DIALOG_NAME=gfplanning"),
    ("msp_idox", r"/planning/search-applications#VIEW\?RefType=PLANNINGCASE"),
    ("planportal", r"\.planportal\.co\.uk/"),
    ("eocella", r"tpKey=eOcella"),
    ("planningexplorer_mvc", r"/PlanningExplorerMVC?/Home/ApplicationDetails"),
    ("planningexplorer_mvc", r"planningexplorer\.[^/]+/Home/ApplicationDetails"),
    ("unidoc", r"/UniDoc/Document/Search/"),
    ("eplanningviewer", r"/eplanningviewer/"),
    ("eplanningviewer", r"/EDMSExternal/Fred/Index/"),
    ("aifusion", r"aifusion\.io/"),
    ("aifusion", r"/publicportalviewer/"),
    ("civica_cx", r"civicacx\.co\.uk/"),
    ("oracle_ords", r"/ords/[^/]+/f\?p=Planning"),
    ("mvm", r"/MVM/Online/(?:DMS/)?DocumentViewer\.aspx"),
    ("ocella", r"/OcellaWeb/showDocuments"),
    ("ocella_casetracker", r"/casetracker/ocella_crossreference\.asp"),
    ("liverpool_doc_explorer", r"/DocumentExplorer/Application/folderview"),
    ("bathnes_custom", r"bathnes\.gov\.uk/planningdocuments="),
    ("ipswich_custom", r"ppc\.ipswich\.gov\.uk/xappndocs"),
    ("jersey_custom", r"gov\.je/citizen/Planning/Pages/PlanningApplicationDocuments"),
]

# Backends by what a lower-cased address contains, first match wins.
BACKENDS = [
    ("other_bespoke", ("runthirdpartysearch",)),
    ("idox_online_applications", ("/online-applications/", "/onlineplanning/", "/online/applicationdetails", "/idoxpa-web/")),
    ("northgate_docexplorer", ("/northgate/documentexplorer/", "/documentexplorer/application/folderview")),
    ("northgateim_websearch", ("northgateim.websearch",)),
    ("aniteim_websearch", ("aniteim",)),
    ("northgate_publicaccess", ("publicaccess_live", "publicaccess.websearch", "publicaccess/searchresult", "externalentrypoint.aspx")),
    ("gov_template_planning_docs", ("/planning/planning-document",)),
    ("swiftlg", ("swiftlg", "wphappdetail")),
    ("causeway", ("causewaydoclist", "causeway")),
    ("ocella", ("ocella",)),
    ("arcus", ("arcus",)),
    ("mvm", ("mvm",)),
    ("necs_assure", ("necsassure", "necs-assure", "necs_assure")),
    ("aifusion", ("aifusion",)),
    ("eplanningviewer", ("eplanningviewer",)),
    ("planning_register", ("planning-register.co.uk",)),
    ("nipp_planningregister", ("planningregister.planningsystemni.gov.uk", "planningsystemni.gov.uk")),
    ("shale_dialog", ("shale", "dialog.page")),
    ("unidoc", ("unidoc",)),
    ("planportal", ("planportal",)),
    ("oracle_ords", ("ords",)),
    ("civica_cx", ("civica",)),
]

# Authorities that merged into others, as canonical_name writes them.
AUTHORITY_ALIASES = {
    "ALLERDALE": "CUMBERLAND",
    "AYLESBURY VALE": "BUCKINGHAMSHIRE",
    "BARROW": "WESTMORLAND FURNESS",
    "BRIGHTON": "BRIGHTON HOVE",
    "CARLISLE": "CUMBERLAND",
    "CHILTERN": "BUCKINGHAMSHIRE",
    "CHILTERN SOUTH BUCKS": "BUCKINGHAMSHIRE",
    "COPELAND": "CUMBERLAND",
    "CORBY": "NORTH NORTHAMPTONSHIRE",
    "CRAVEN": "NORTH YORKSHIRE",
    "DAVENTRY": "WEST NORTHAMPTONSHIRE",
    "EAST NORTHAMPTONSHIRE": "NORTH NORTHAMPTONSHIRE",
    "EDEN": "WESTMORLAND FURNESS",
    "HAMMERSMITH": "HAMMERSMITH FULHAM",
    "HARROGATE": "NORTH YORKSHIRE",
    "KENSINGTON": "KENSINGTON CHELSEA",
    "KETTERING": "NORTH NORTHAMPTONSHIRE",
    "MENDIP": "SOMERSET",
    "NORTHAMPTON": "WEST NORTHAMPTONSHIRE",
    "RICHMOND": "RICHMOND THAMES",
    "RICHMONDSHIRE": "NORTH YORKSHIRE",
    "RYEDALE": "NORTH YORKSHIRE",
    "SCARBOROUGH": "NORTH YORKSHIRE",
    "SEDGEMOOR": "SOMERSET",
    "SELBY": "NORTH YORKSHIRE",
    "SOMERSET WEST TAUNTON": "SOMERSET",
    "SOUTH BUCKS": "BUCKINGHAMSHIRE",
    "SOUTH LAKELAND": "WESTMORLAND FURNESS",
    "SOUTH NORTHAMPTONSHIRE": "WEST NORTHAMPTONSHIRE",
    "SOUTH SOMERSET": "SOMERSET",
    "WELLINGBOROUGH": "NORTH NORTHAMPTONSHIRE",
    "WINDSOR": "WINDSOR MAIDENHEAD",
    "WYCOMBE": "BUCKINGHAMSHIRE",
}

_NAMED = ("document_type", "description", "path")
#: Buckets of documents without text, by their type, description and path: of each rule one line must hold, all its clauses.
CANDIDATE_BUCKETS = [
    ("mcs_calculator", [[(_NAMED, "contains", ("mcs",)), (_NAMED, "contains", ("020", "calc", "calculator"))]]),
    ("consultee_response", [[("document_type", "contains", ("consult", "consultee"))], [("description", "contains", ("statutory reply",))]]),
    ("noise_impact_assessment", [[("description", "contains", ("noise impact",))], [("document_type", "contains", ("noise impact",))]]),
    ("acoustic_report", [[(_NAMED, "contains", ("acoustic",))]]),
    ("manufacturer_spec", [[("description", "contains", ("spec", "manufacturer", "vaillant", "daikin"))]]),
    ("drawing_or_plan", [[("document_type", "contains", ("drawing", "plan"))], [("description", "contains", ("elevation",))]]),
    ("supporting_information", [[("document_type", "contains", ("supporting",))], [("description", "contains", ("supporting",))]]),
    ("report", [[("document_type", "contains", ("report",))], [("description", "contains", ("report",))]]),
    ("statement", [[("document_type", "contains", ("statement",))], [("description", "contains", ("statement",))]]),
]

#: Ranks of documents, lower first: by type, then by file name.
DOCUMENT_RANKS = [
    (0, [[("document_type", "in", ("decision", "decision notice", "decision letter", "recommendation and reasons report"))]]),
    (
        1,
        [[("document_type", "in", (
            "officer report", "officer reports", "delegated report", "report of handling", "delegated officer report", "case officer report",
            "application committee / delegated report", "committee report",
        ))]],
    ),
    (2, [[("document_type", "in", ("recommendation", "case report", "planning report"))]]),
    (
        3,
        [[("document_type", "in", (
            "acoustic report", "acoustic assessment", "noise assessment", "sound assessment", "noise report", "noise impact assessment",
        ))]],
    ),
    (
        4,
        [[("document_type", "in", (
            "heritage statement", "heritage impact assessment", "design and access statement", "design & access statement",
            "heritage and design statement",
        ))]],
    ),
    (5, [[("file_name", "matches", r"decision[_ ]notice|decision[_ ]letter|refus(?:al|ed)?|permission|granted|approval|approved")]]),
    (6, [[("file_name", "matches", r"officer|delegated|report[_ ]of[_ ]handling|report[_ ]recommendation|case[_ ]officer|committee[_ ]report")]]),
    (7, [[("file_name", "matches", r"acoustic|noise[_ ]?(assessment|report|impact)|sound[_ ]assessment|bs[_ ]?4142|bs[_ ]?8233|mcs[_ ]?020")]]),
    (8, [[("file_name", "matches", r"heritage|design[_ ]?and[_ ]?access|listed[_ ]?building")]]),
]
#: Fixed value: file names that come first among documents of no other rank.
NAMED_PRODUCT = r"(air[_ ]source|heat[_ ]pump|\bashp\b|brochure)"

#: Families of metrics by what their names hold.
METRIC_FAMILIES = [
    ("volume", [[("metric_name", "contains", ("received", "decided", "allowed", "count", "total"))]]),
    ("rate_percent", [[("metric_name", "contains", ("percent", "rate", "share"))]]),
    ("timeliness_days", [[("metric_name", "contains", ("day",))]]),
]

#: Names of metrics that have a shorter one.
METRIC_NAMES = {
    "s78_planning_appeals_number_decided": "s78_decided_count",
    "s78_planning_appeals_number_allowed": "s78_allowed_count",
    "householder_appeals_number_decided": "householder_decided_count",
    "householder_appeals_number_allowed": "householder_allowed_count",
    "s174_enforcement_notice_appeals_number_decided": "s174_decided_count",
    "s174_enforcement_notice_appeals_quashed_or_granted": "s174_allowed_count",
    "s174_enforcement_notice_appeals_notice_upheld_or_varied": "s174_upheld_or_varied_count",
    "received": "received_count",
    "decided": "decided_count",
    "allowed": "allowed_count",
    "total": "total_count",
    "written_representations": "written_representations_count",
    "hearings": "hearings_count",
    "inquiries": "inquiries_count",
    "all": "all_count",
}

#: Columns that a canonical dimension is taken from, the first that is filled.
DIMENSION_NAMES = {
    "period": ("month", "quarter", "year", "period", "period_end"),
    "geography": ("region", "lpa_name", "local_planning_authority", "authority", "geography"),
    "geography_code": ("ons_code", "ons_lpa_code", "lpa_code", "geography_code"),
    "appeal_type": ("appeal_type", "casework_type", "type_of_casework"),
    "procedure": ("procedure",),
    "stage": ("stage", "stages"),
    "service_standard": ("service_standard", "gov_uk_timeliness", "timeliness"),
}


#: Failure codes by parts of an error's text, in order.
FAILURE_CODES = [
    ("dns_error", ["name or service not known", "nodename nor servname"]),
    ("http_403", ["403"]),
    ("http_404", ["404"]),
    ("http_500", ["500"]),
    ("connection_reset", ["server disconnected", "connection reset"]),
    ("timeout", ["timeout", "timed out"]),
    ("tls_error", ["certificate", "ssl", "tls"]),
    ("blocked", ["captcha", "block", "access denied"]),
]

#: Buckets of application types by parts of the type, in order; else ``full``.
APPLICATION_TYPES = [
    ("heritage", ["listed", "heritage", "conservation"]),
    ("outline", ["outline"]),
    ("amendment", ["amendment", "non-material", "minor"]),
    ("conditions", ["condition", "discharge"]),
    ("trees", ["tree"]),
    ("advertising", ["advert"]),
]

#: Coarse decisions by parts of the decision, in order; else ``other``.
COARSE_DECISIONS = [
    ("refused", ["refuse", "refusal"]),
    ("approved", ["permit", "permission", "approve", "conditional", "grant", "discharge"]),
    ("withdrawn", ["withdraw"]),
]

#: Document families by parts of type and description, in order; else ``other``.
DOCUMENT_FAMILIES = [
    ("decision", ["decision"]),
    ("officer_report", ["officer report", "delegated report", "report final"]),
    ("noise", ["noise", "sound", "acoustic", "bs4142"]),
    ("spec_calc", ["heat loss", "manual sound calculator", "technical specification", "mcs 020"]),
    ("consultee", ["consultee", "environmental health", "comment", "response"]),
    ("drawing", ["drawing", "plan", "elevation", "site location"]),
    ("application_form", ["application form"]),
]

#: Works that a description bundles with others; they begin a word.
BUNDLED_WORKS = [
    "extension", "extn", "loft", "conversion", "garage", "outbuilding", "annex", "porch", "store", "garden room", "demolition", "new dwelling", "new build",
    "change of use", "alteration", "orangery", "conservatory", "summerhouse", "first floor", "two storey", "two-storey", "single storey", "single-storey",
    "side extension", "rear extension", "listed building", "refurbishment", "renovat",
]
