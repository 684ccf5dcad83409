"""Fixed values of the analysis reproduced here.

These values must equal those of the original analysis for its results to come out the same. They are
stated as they appear there, in their original order. Everything else in the library takes them as
overridable parameters.
"""

# ---------------------------------------------------------------------------------------------------
# Fixed values (do not edit to change behaviour: pass other values as parameters instead)
# ---------------------------------------------------------------------------------------------------

# Missing-value markers of the stimulus tracker file.
NA_TOKENS = ("-", "NA", "")

# Unit factors.
BILLION = 1e9
INFLATION_2015_TO_2019 = 1.0728
GDP_SHARE_FACTOR = 10e10  # written as 10e10 in the source: the share of GDP is total (bn) / GDP * 1e11

# Stimulus categories.
HEALTH = "Health sector spending"
GENERAL = "General spending"
LIQUIDITY = "Liquidity support"

# Region recodes of the region sheet and of the regional roll-up; the dropped country; unmatched code.
REGION_SHEET_RECODE = {"OECD90+EU": "OECD+"}
DROPPED_COUNTRIES = ("Netherlands Antilles",)
UNMATCHED_CODE = "EU"
CODE_REPAIR = {"EUM": "NAM"}
STIM_REGION_RECODE = {"EU": "OECD+"}
EU_NAME = "European Union"

# Country sets.
IAM_REGIONS = ("ASIA", "LAM", "MAF", "OECD+", "REF", "World")
BIG_ECONOMIES = ("CHN", "EU", "USA", "IND")
EU_MEMBERS = ("AUT", "BEL", "BGR", "HRV", "CYP", "CZE", "DNK", "EST", "FIN", "FRA", "DEU", "GRC", "HUN",
              "IRL", "ITA", "LVA", "LTU", "LUX", "MLT", "NLD", "POL", "PRT", "ROM", "SVK", "SVN", "ESP", "SWE", "EU")
G20 = ("CAN", "FRA", "DEU", "ITA", "JPN", "GBR", "USA", "EU", "ARG", "AUS",
       "BRA", "CHN", "IND", "IDN", "MEX", "RUS", "SAU", "ZAF", "KOR", "TUR")
FIG_ECONOMIES = ("EU", "IND", "USA", "CHN")

# GDP: the constant used for the EU and the economies listed beside it.
EU_GDP_2019 = 15.5e12
SELECTED_ECONOMIES = ("USA", "CHN", "IND")

# Energy technologies, the two sectors and their members, region names, anchor model, scenarios.
TECHNOLOGIES = ("Energy Efficiency", "CCS", "Electricity - T&D and Storage", "Extraction and Conversion - Nuclear",
                "Extraction and Conversion - Bioenergy", "Hydrogen - Non-fossil", "Electricity - Non-bio Renewables",
                "Hydrogen - Fossil", "Electricity - Fossil Fuels w/o CCS", "Extraction and Conversion - Fossil Fuels")
SECTORS = ("Fossil fuels", "Low carbon sources")
FOSSIL = ("Electricity - Fossil Fuels w/o CCS", "Hydrogen - Fossil", "Extraction and Conversion - Fossil Fuels")
LOW_CARBON = ("Extraction and Conversion - Nuclear", "CCS", "Electricity - Non-bio Renewables", "Hydrogen - Non-fossil",
              "Extraction and Conversion - Bioenergy", "Electricity - T&D and Storage", "Energy Efficiency")
MODEL_REGION_RECODE = {"R5ASIA": "ASIA", "R5LAM": "LAM", "R5MAF": "MAF", "R5OECD90+EU": "OECD+", "R5REF": "REF"}
ANCHOR_MODEL = "MESSAGEix-GLOBIOM"
TARGET, BASELINE = "1.5C", "CPol"

# Ordered categories and investment types of the Figure-1 table.
CATEGORY_LEVELS = ("General spending", "Health sector spending", "Liquidity support", "Low carbon sources", "Fossil fuels")
INVEST_TYPES = ("Energy investment", "Stimulus", "Investment shift", "Investment shift (5 years)")
