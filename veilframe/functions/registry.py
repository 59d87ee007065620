"""The registry: 52 types of personal data, their ranks and the regular expressions of 43 of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class PiiType:
    id: str
    name: str
    category: str
    sensitivity: str
    pattern: str

    @property
    def rank(self) -> int:
        return RANKS.get(self.sensitivity, 1)


# The order of sensitivities; an unknown one has rank 1.
RANKS = {"Critical": 6, "Very High": 5, "High": 4, "Medium": 3, "Low": 2}

# Types as (id, name, category, sensitivity, pattern); no pattern: found by models only.
TYPES = (
    PiiType("aadhaar", "Aadhaar Number", "Government ID", "Very High", r"(?<!\d)(?:\d{4}[\s.\-]*\d{4}[\s.\-]*\d{4}|\d{12})(?!\d)"),
    PiiType("pan", "PAN Number", "Government ID", "High", r"(?i)\b[A-Z]{5}[\s.\-]*[0-9]{4}[\s.\-]*[A-Z]\b"),
    PiiType("passport", "Passport Number", "Government ID", "Very High", r"(?i)\b(?:passport\s*(?:no|num(?:ber)?|#)?)\s*[:\-.]?\s*([A-Z0-9][\s.\-]?[A-Z0-9]{5,8})\b"),
    PiiType("voter_id", "Voter ID", "Government ID", "High", r"(?i)(?:epic\s*(?:no|num(?:ber)?|id)?|voter\s*(?:id|no|card|number))\s*[:\-#]?\s*([A-Z]{3}[0-9]{7})|\b([A-Z]{3}[0-9]{7})\b"),
    PiiType("driving_license", "Driving Licence", "Government ID", "High", r"\b(?:DL|HR|GJ|MH|KA|TN|UP|WB|AP|TS|PB|RJ|MP|BR|OR|KL|AS|UK|HP|CG|JH|GA|MN|ML|NL|TR|SK|AR|MZ|DN|DD|CH|AN|JK|LA|PY|LD)\d{2}\s?\d{4}\s?\d{7}\b"),
    PiiType("ssn", "Social Security Number", "Government ID", "Very High", r"(?i)\b(?:ssn|social\s*security\s*(?:number|no|num|#)?|s\.s\.n\.?|taxpayer\s*id)\s*[:\-#]?\s*(?!000|666|9\d{2})\d{3}[\s.\-]?(?!00)\d{2}[\s.\-]?(?!0000)\d{4}\b"),
    PiiType("abha_number", "Abha Number", "Government ID", "Very High", r"(?i)\b(?:abha\s*(?:no|num(?:ber)?|#|id)?)\s*[:\-]?\s*\d{2}[\s.\-]*\d{4}[\s.\-]*\d{4}[\s.\-]*\d{4}\b"),
    PiiType("credit_card", "Credit/Debit Card Number", "Financial", "High", r"\b(?:\d[ -]*?){13,16}\b"),
    PiiType("bank_account", "Bank Account Number", "Financial", "Very High", r"(?i)(?:\b(?:account\s*(?:no|num(?:ber)?|#)|a\/c|acct)\s*[:\-]?\s*([0-9]{9,18})\b)|(?:\b(?:bank|branch|ifsc|micr|cheque|passbook|statement)\s*[:\-]?\s*[\s\S]{0,30}?([0-9]{9,18})\b)"),
    PiiType("upi", "UPI ID", "Financial", "High", r"\b[a-zA-Z0-9.\-_]{2,}@(?:okaxis|okhdfcbank|oksbi|okicici|ybl|axisbank|upi|paytm|ibl|timecosmos|apl|jupiter|fbl|rbl|kotak|barodampay|centralbank|idbi|pnb|aubank|indus|mahb|scb|abfspay|nsdl|juspay)\b"),
    PiiType("ifsc", "IFSC Code", "Financial", "Medium", r"(?i)\b[A-Z]{4}0[A-Z0-9]{6}\b"),
    PiiType("iban", "IBAN", "Financial", "Very High", r"\b(?:AL|AD|AT|AZ|BH|BY|BE|BA|BR|BG|CR|HR|CY|CZ|DK|DO|EG|SV|EE|FO|FI|FR|GE|DE|GI|GR|GL|GT|HU|IS|IQ|IE|IL|IT|JO|KZ|XK|KW|LV|LB|LI|LT|LU|MT|MR|MU|MD|MC|ME|NL|MK|NO|PK|PS|PL|PT|QA|RO|LC|SM|ST|SA|RS|SC|SK|SI|ES|SE|CH|TL|TN|TR|UA|AE|GB|VA|VG|YE)\d{2}[\s]?(?:[A-Z0-9]{4}[\s]?){2,7}[A-Z0-9]{1,4}\b"),
    PiiType("nhs_number", "NHS Number", "Government ID", "Very High", r"(?i)\b(?:nhs\s*(?:no|num(?:ber)?|#)?)\s*[:\-]?\s*(\d{3}[\s\-]?\d{3}[\s\-]?\d{4})\b"),
    PiiType("expiry", "Card Expiry Date", "Financial", "Medium", r"(?i)\b(?:exp(?:iry)?|valid\s*(?:thru|through|till))\s*[:\-]?\s*(?:0[1-9]|1[0-2])[\/\-]\d{2,4}\b"),
    PiiType("cvv", "CVV / CVC", "Financial", "Critical", r"(?i)\b(?:cvv|cvc|security\s*code)\s*[:\-]?\s*\d{3,4}\b"),
    PiiType("annual_income", "Annual Income", "Financial", "High", r"(?i)\b(?:annual\s*income|yearly\s*income|income|salary|ctc|gross\s*pay)\s*[:\-]?\s*[\u20B9$]?\s*[\d,]+(?:\.\d{1,2})?\s*(?:per\s*annum|p\.a\.|annually|/year|lakhs?|crores?|lpa)?\b"),
    PiiType("credit_score", "Credit Score", "Financial", "High", r"(?i)\b(?:credit\s*score|cibil\s*score|cibil|equifax\s*score)\s*[:\-]?\s*\d{3,4}\b"),
    PiiType("user_id", "Username / User ID", "Authentication", "Medium", r"(?i)\b(?:username|user(?:\s*id)?|login(?:\s*id)?)\s*[:\-]?\s*([A-Za-z0-9._@\-]{3,50})"),
    PiiType("password", "Password", "Authentication", "Critical", r"(?i)\b(?:password|passwd|pwd)\s*[:\-=]?\s*(\S{6,})"),
    PiiType("name", "Person Name", "Personal", "Medium", r""),
    PiiType("father_name", "Father's Name", "Personal", "Medium", r"(?im)(?:(?:S|D|W|C)\/O\.?|Son\s+of|Daughter\s+of|Wife\s+of|Care\s+of|Father(?:'?s)?(?:\s*Name)?|\bPita\b|\bF\.?Name\b)\s*[:\-]?\s*([A-Z][A-Za-z\s\.]{2,40})(?=\n|\r|$|\s{2,})|^\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}\r?\n[A-Z]{2,}(?:\s+[A-Z]{2,}){1,3}\r?\n([A-Z]{2,}(?:\s+[A-Z]{2,}){1,3})\b"),
    PiiType("dob", "Date of Birth", "Personal", "High", r"(?im)(?:(?:dob|d\.?o\.?b\.?|date\s*of\s*birth|birth\s*(?:date|day)|born\s*(?:on)?|\u091c\u0928\u094d\u092e\s*\u0924\u093f\u0925\u093f|\u091c\u0928\u094d\u092e\u0926\u093f\u0928|\u091c\u0928\u094d\u092e\s*\u0926\u093f\u0928\u093e\u0902\u0915|\u092a\u0948\u0926\u093e\u0907\u0936|\u09ac\u09bf\u09ac\u09be\u09b9\s*\u09a4\u09be\u09b0\u09bf\u0996|\u099c\u09a8\u09cd\u09ae\s*\u09a4\u09be\u09b0\u09bf\u0916|\u062a\u0627\u0631\u064a\u062e \u0627\u0644\u0645\u064a\u0644\u0627\u062f|\u0baa\u0bbf\u0bb1\u0ba8\u0bcd\u0ba4\s*\u0ba4\u0bc7\u0ba4\u0bbf)\s*[:\-]?\s*|^(?=\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}(?:\s|$)))(\d{1,2}[\/\-\.]\d{1,2}[\/\-\.]\d{2,4}|\d{4}[\/\-\.]\d{1,2}[\/\-\.]\d{1,2})\b"),
    PiiType("address", "Physical Address", "Personal", "Medium", r"(?i)\b(?:address|addr|residence|पता|ঠিকানা|পতা|முகவரி|చిరునామా)\s*[:\-]?\s*([A-Za-z0-9\u0900-\u097F\u0980-\u09FF\u0B80-\u0BFF\u0C00-\u0C7F][A-Za-z0-9\s,./#\-\u0900-\u097F\u0980-\u09FF\u0B80-\u0BFF\u0C00-\u0C7F]{8,300})(?=\n\n\n|\Z|(?:\n[A-Z][a-z]+\s*[:\-]))"),
    PiiType("gender", "Gender", "Demographic", "Low", r"(?i)(?:\b(?:gender|sex|लिंग|جنس)\s*[:\-\/]?\s*)?(?<![A-Za-z])(MALE|FEMALE|Male|Female|TRANSGENDER|Non[\s\-]Binary|Other|पुरुष|महिला|પુરુષ|મહિલા|ਪੁਰਸ਼|ਔਰਤ)(?![A-Za-z])"),
    PiiType("age", "Age", "Demographic", "Low", r"(?i)\b(?:age|उम्र|आयु|বয়স|வயது|వయస్సు)\s*[:\-]?\s*(\d{1,3})\s*(?:years?|yrs?|वर्ष|साल)?\b"),
    PiiType("nationality", "Nationality", "Personal", "Low", r""),
    PiiType("marital_status", "Marital Status", "Demographic", "Low", r"(?i)\b(?:marital\s*status)\s*[:\-]?\s*(?:single|married|divorced|widowed|separated|unmarried)\b"),
    PiiType("diagnosis", "Medical Diagnosis", "Medical", "Critical", r""),
    PiiType("allergies", "Allergies", "Medical", "Critical", r"(?i)\b(?:allerg(?:y|ies|ic\s*to))\s*[:\-]?\s*([A-Za-z][A-Za-z,\s]{2,50})(?=\n|$|;|\|)"),
    PiiType("treatment_history", "Treatment History", "Medical", "Critical", r""),
    PiiType("prescription", "Prescription / Medication", "Medical", "Critical", r"(?i)\b(?:prescribed?|medication|tablet|capsule|mg\s*/\s*(?:day|dose))\b"),
    PiiType("immunization", "Immunization Record", "Medical", "High", r"(?i)\b(?:vaccin(?:e|ated|ation)|immuniz(?:ed|ation)|booster)\b"),
    PiiType("blood_group", "Blood Group", "Medical", "Medium", r"\b(?:A|B|AB|O)[+-]\b"),
    PiiType("mrn", "Medical Record Number", "Medical", "Very High", r"(?i)\b(?:mrn|patient\s*id|record\s*(?:no|num(?:ber)?))\s*[:\-#]?\s*([A-Z0-9]{4,15})\b"),
    PiiType("insurance_policy", "Insurance Policy Number", "Insurance", "High", r"(?i)\b(?:policy\s*(?:no|num(?:ber)?|#))\s*[:\-]?\s*([A-Z0-9/\-]{5,20})\b"),
    PiiType("insurance_provider", "Insurance Provider", "Insurance", "Low", r""),
    PiiType("occupation", "Occupation / Job Title", "Employment", "Low", r""),
    PiiType("employee_id", "Employee ID", "Employment", "Medium", r"(?i)\b(?:emp(?:loyee)?\s*(?:id|no|code))\s*[:\-#]?\s*([A-Z0-9]{3,15})\b"),
    PiiType("corporate_email", "Corporate Email", "Employment", "Medium", r"[A-Za-z0-9._%+\-]+@(?!(?:gmail|yahoo|hotmail|outlook|rediff|icloud|proton)\.)[A-Za-z0-9\-]+\.(?:com|org|net|in|co\.in|gov\.in)"),
    PiiType("organization", "Organisation Name", "Employment", "Low", r""),
    PiiType("educational_qualification", "Educational Qualification", "Educational", "Low", r"\b(?:B\.(?:Sc|Tech|E|Com|A|Ed)|BSc|BTech|BE|BEd|BCom|BA|M\.(?:Sc|Tech|E|Com|B\.A|Ed|Phil)|MSc|MTech|ME|MBA|MEd|MPhil|M\.D\.|Ph\.D\.?|PhD|MBBS|M\.B\.B\.S|[Dd]iploma|[Bb]achelor(?:'?s)?|[Mm]aster(?:'?s)?|[Dd]octorate|[Pp]ost[Gg]raduate|[Uu]ndergraduate)\b"),
    PiiType("email", "Email Address", "Contact", "High", r"[A-Za-z0-9._%+\-]+(?:[ \t\n]*\.[ \t\n]*[A-Za-z0-9._%+\-]+)*[ \t\n]*@[ \t\n]*[A-Za-z0-9\-]+(?:[ \t\n]*\.[ \t\n]*[A-Za-z0-9\-]+)*[ \t\n]*\.[ \t\n]*[A-Za-z]{2,}"),
    PiiType("phone", "Phone Number", "Contact", "Medium", r"(?:\+\d{1,3}[\s\-.]?(?:\(0?\d{1,4}\)[\s\-.]?)?\d{3,5}[\s\-.]?\d{3,5}(?:[\s\-.]?\d{2,5})?|(?:phone|mobile|tel|ph|mob|contact)\s*[:\-]?\s*(?:\+\d{1,3}[\s\-.]?)?\d{3,5}[\s\-.]?\d{3,5}(?:[\s\-.]?\d{2,5})?|(?:\+91[\s\-.]?|0)?[6-9]\d{4}[\s\-.]?\d{5}(?!\d))(?!\d)"),
    PiiType("pincode", "Postal / PIN Code", "Geo", "Low", r"(?i)\b(?:pin\s*(?:code)?|postal\s*(?:code)?|zip)\s*[:\-]?\s*(\d{6})\b"),
    PiiType("city", "City / Town", "Geo", "Low", r""),
    PiiType("medication", "Medication / Drug Name", "Medical", "High", r""),
    PiiType("weight", "Weight", "Medical", "Low", r"(?i)\b(?:weight|wt|वजन|ভর|எடை)\s*[:\-]?\s*\d{1,3}(?:\.\d{1,2})?\s*(?:kg|kgs|kilograms?|lbs?|pounds?|g|gm|grams?)?\b"),
    PiiType("height", "Height", "Medical", "Low", r"(?i)\b(?:height|ht|ऊंचाई|उचाई|উচ্চতা|உயரம்)\s*[:\-]?\s*\d{1,3}(?:\.\d{1,2})?\s*(?:cm|cms|centimeters?|m|meters?|ft|feet|in|inches|')?\b"),
    PiiType("lab_test_results", "Lab Test Results", "Medical", "High", r"(?i)\b(?:lab\s*(?:result|report|test)|blood\s*(?:report|test|sugar|pressure)|urine\s*test|hemoglobin|cholesterol|glucose|creatinine|bp\s*[:\-])\b"),
    PiiType("insurance_account_number", "Insurance Account Number", "Insurance", "High", r"(?i)\b(?:insurance\s*(?:account|acct|id|member)\s*(?:no|num(?:ber)?|#)?)\s*[:\-]?\s*([A-Z0-9\-]{5,20})\b"),
    PiiType("contact", "Contact Information", "Contact", "Medium", r"(?i)\b(?:contact\s*(?:info|details?|number|no|person)?)\s*[:\-]?\s*([\S].{2,80})"),
    PiiType("ip_address", "IP Address", "Other", "Medium", r"\b(?:(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\.){3}(?:25[0-5]|2[0-4]\d|[01]?\d\d?)\b"),
)

BY_ID = {t.id: t for t in TYPES}
PATTERN_TYPES = tuple(t for t in TYPES if t.pattern)
SEMANTIC_ONLY = tuple(t.id for t in TYPES if not t.pattern)

# Types that a semantic engine is trusted with where one runs.
MODEL_PREFERRED = ("name", "address", "organization", "diagnosis", "allergies", "treatment_history")


def register_pattern(type_id: str, pattern: str, sensitivity: str = "Medium", name: str | None = None, category: str = "Personal") -> None:
    """Adds a type, or gives one another pattern, from then on and for this process; scans built afterwards look for it."""
    global TYPES, BY_ID, PATTERN_TYPES, SEMANTIC_ONLY
    own = PiiType(type_id, name or type_id.replace("_", " ").title(), category, sensitivity, pattern)
    TYPES = tuple(own if t.id == type_id else t for t in TYPES) if type_id in BY_ID else (*TYPES, own)
    BY_ID = {t.id: t for t in TYPES}
    PATTERN_TYPES = tuple(t for t in TYPES if t.pattern)
    SEMANTIC_ONLY = tuple(t.id for t in TYPES if not t.pattern)


def pii_types(spark: SparkSession) -> DataFrame:
    """The registry as a table: pii_type, name, category, sensitivity, rank, has_pattern, ord."""
    rows = [(t.id, t.name, t.category, t.sensitivity, t.rank, bool(t.pattern), i) for i, t in enumerate(TYPES)]
    return spark.createDataFrame(rows, "pii_type string, name string, category string, sensitivity string, rank int, has_pattern boolean, ord int")
