"""Word lists, labels and patterns that results depend on."""

# Letters that names are folded to.
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta",
    "μ": "u", "µ": "u", "’": "'",
}

# Names that stand for no value.
JUNK = (
    r"^(n/?a|none|not specified|not mentioned|unknown|unspecified|other|various|"
    r"multiple|several|general|tbd|-+|misc\w*|none explicitly mentioned|water|"
    r"no\b.*(mention|specif)\w*|.*not (applicable|available).*)$"
)

# Labels and the patterns that give them, the first that matches wins.
DOMAIN = [
    ("Biosensors",               r"biosens|biensing|sensing"),
    ("Diagnostics",              r"diagnos|detection|screening"),
    ("Therapeutics",             r"therapeut|biologic|oncolog|medicin|biomedical|drug|vaccine"),
    ("Bioremediation",           r"bioremediat|environment|pollut|waste|water treat"),
    ("Biomanufacturing",         r"biomanufact|manufactur|fermentat|bioproduct|biosynth|biotechnolog"),
    ("Biomaterials",             r"biomaterial|material"),
    ("Foundational tools",       r"foundational|tool|software|hardware|computational|modell?ing"),
    ("Agriculture & food",       r"agricultur|food|nutrition|crop|biopesticide|farming"),
    ("Energy",                   r"energy|biofuel|fuel"),
    ("Education & outreach",     r"education|outreach|policy|practice"),
    ("Biosafety & security",     r"biosafet|biosecur|biocontain"),
]

TECHNIQUE = [
    ("qPCR / RT-qPCR",           r"\b(q-?pcr|rt-?q?-?pcr|real.?time pcr|quantitative pcr)\b|reverse transcri"),
    ("Isothermal amplification", r"isothermal|recombinase polymerase|\brpa\b|rolling circle|\blamp\b"),
    ("PCR",                      r"\bpcr\b|polymerase chain reaction|primer design"),
    ("Gel electrophoresis",      r"electrophoresis"),
    ("SDS-PAGE",                 r"sds.?page|coomassie"),
    ("Western blot",             r"western blot"),
    ("ELISA",                    r"\belisa\b"),
    ("Flow cytometry",           r"flow cytometry|facs"),
    ("Gibson assembly",          r"gibson"),
    ("Golden Gate assembly",     r"golden gate"),
    ("BioBrick assembly",        r"biobrick|3a assembly"),
    ("Restriction digestion",    r"restriction|digest"),
    ("Ligation",                 r"\bligat|ligase"),
    ("Molecular cloning",        r"clon(e|ing)|plasmid construction|vector construction|^plasmids?$|recombinant dna|blue.?white"),
    ("Transformation",           r"transformation|heat.?shock|electroporation|conjugation|competent cell"),
    ("Transfection",             r"transfect|transduc|lentivir"),
    ("CRISPR",                   r"crispr|cas9|cas12|cas13|guide rna|\bgrna\b"),
    ("Site-directed mutagenesis", r"mutagenes"),
    ("Directed evolution",       r"directed evolution|phage display|\bselex\b"),
    ("Sequencing",               r"sequenc"),
    ("DNA / gene synthesis",     r"(dna|gene) synthesis"),
    ("Codon optimisation",       r"codon"),
    ("Homologous recombination", r"recombination|knock.?(in|out)"),
    ("RNA interference",         r"rna interference|\brnai\b|sirna|antisense"),
    ("Protein expression",       r"protein expression|recombinant protein|overexpress|induction|iptg|heterologous expression"),
    ("Protein purification",     r"purificat|chromatograph|affinity|ni-?nta"),
    ("Protein engineering",      r"protein engineering|enzyme engineering|rational design"),
    ("Genetic circuit design",   r"promoter engineering|genetic circuit|circuit design|logic gate|rbs engineering|rbs calculator"),
    ("Protein secretion & display", r"secretion|surface display|cell surface"),
    ("Lateral flow / paper tests", r"lateral flow|paper.?based|test strip"),
    ("Freeze-drying",            r"freeze.?dr|lyophili"),
    ("Software & web development", r"software|web ?development|app development|programming"),
    ("Spectroscopy & electrochemistry", r"spectroscop|light scattering|\bdls\b|voltammetr|electrochem|impedance|circular dichroism|\bnmr\b|raman|ftir"),
    ("Fluorescence microscopy",  r"fluorescen\w* microscop|confocal"),
    ("Electron microscopy",      r"electron microscop|\b(sem|tem)\b|atomic force"),
    ("Microscopy",               r"microscop"),
    ("Fluorescence assays",      r"fluorescen"),
    ("Spectrophotometry",        r"spectrophotom|od600|absorbance|plate reader|nanodrop"),
    ("Mass spectrometry",        r"mass spec|gc-?ms|lc-?ms|maldi"),
    ("Chromatography (HPLC/GC)", r"\bhplc\b|gas chromatograph|liquid chromatograph"),
    ("Cell culture & fermentation", r"cell culture|liquid culture|plating|streak|fermentat|bioreactor|bacterial culture|microbiolog|autoclav|steriliz|antibiotic selection|culturing"),
    ("Growth assays",            r"growth (curve|assay)|od measurement|viability|\bcfu\b|\bmtt\b|cck-?8|cytotox"),
    ("Enzyme assays",            r"enzyme (activity|assay)|kinetic|bradford|\bbca\b|colorimetric|biochemical assay|luciferase assay|luminescen"),
    ("Nucleic acid extraction",  r"miniprep|midiprep|maxiprep|(dna|rna|plasmid|gel) extraction|(plasmid|dna|rna) isolation"),
    ("Molecular docking",        r"docking"),
    ("Structure prediction",     r"alphafold|structure prediction|homology model|rosetta"),
    ("Molecular dynamics",       r"molecular dynamic|\bmd simulation"),
    ("Machine learning",         r"machine learning|deep learning|neural net"),
    ("Mathematical modelling",   r"model|simulat|flux balance|\bfba\b"),
    ("Bioinformatics",           r"bioinformatic|blast|alignment|genome assembly|data analysis"),
    ("Microfluidics",            r"microfluid"),
    ("3D printing",              r"3d print|additive manufact"),
    ("Optogenetics",             r"optogenet"),
    ("Quorum sensing",           r"quorum"),
    ("Cell-free systems",        r"cell.?free|tx-?tl|in vitro transcription"),
    ("Metabolic engineering",    r"metabolic engineering|pathway engineering"),
    ("Genetic engineering",      r"genetic (engineering|modification)|synthetic biology|molecular biology|genome editing"),
    ("Centrifugation & lysis",   r"centrifug|sonicat|lysis"),
]

CHASSIS = [
    ("E. coli",                  r"\be\.? ?coli\b|escherichia"),
    ("S. cerevisiae (yeast)",    r"cerevisiae|saccharomyces|\byeast\b"),
    ("P. pastoris (yeast)",      r"pastoris|komagataella"),
    ("Other yeast",              r"yarrowia|kluyveromyces|candida|schizosaccharomyces"),
    ("B. subtilis",              r"subtilis"),
    ("Lactic acid bacteria",     r"lactococcus|lactobacillus|lacticaseibacillus|\bl\.? lactis\b"),
    ("Pseudomonas",              r"pseudomonas"),
    ("Cyanobacteria",            r"synechocystis|synechococcus|cyanobact|anabaena"),
    ("Algae",                    r"chlamydomonas|chlorella|nannochloropsis|dunaliella|\balgae?\b|diatom"),
    ("Bacillus (other)",         r"bacillus"),
    ("Vibrio",                   r"vibrio"),
    ("Shewanella",               r"shewanella"),
    ("Agrobacterium / Rhizobium", r"agrobacterium|rhizobium"),
    ("Corynebacterium",          r"corynebact"),
    ("Salmonella / Listeria",    r"salmonella|listeria"),
    ("Mycobacterium",            r"mycobact"),
    ("Streptomyces",             r"streptomyces"),
    ("Clostridium",              r"clostridi"),
    ("HEK293",                   r"hek ?293"),
    ("CHO cells",                r"\bcho\b|chinese hamster"),
    ("HeLa",                     r"hela"),
    ("Mammalian cells (other)",  r"mammalian|human cell|huvec|\bmcf|u2os|jurkat|hepg2|thp-?1|macrophage|stem cell"),
    ("Plants",                   r"arabidopsis|nicotiana|tobacco|\bplant|oryza|zea mays|solanum"),
    ("Insects / nematodes",      r"drosophila|elegans|\bsf9\b|insect|bombyx"),
    ("Zebrafish / mouse",        r"zebrafish|danio|\bmouse\b|murine|\brat\b"),
    ("Fungi",                    r"aspergillus|trichoderma|pleurotus|ganoderma|\bfung(us|i)\b|penicillium"),
    ("Phage",                    r"phage|lambda"),
    ("Cell-free system",         r"cell.?free|tx-?tl"),
]

MOLECULE = [
    ("Heavy metals",             r"cadmium|\blead\b|mercury|arsenic|chromium|\bcopper\b|\bzinc\b|nickel|heavy metal|\b(pb|cd|hg|cu|zn|ni|cr) ?[1-6]?\+|^(pb|cd|hg)$"),
    ("Plastics (PET & micro)",   r"\bpet\b|polyethylene terephthalate|microplastic|plastic|terephthalic|ethylene glycol|polystyrene|polyurethane|\btpa\b|\bmhet\b"),
    ("Antibiotics",              r"antibiotic|penicillin|ampicillin|kanamycin|tetracyclin|chloramphenicol|vancomycin"),
    ("Pesticides & herbicides",  r"pesticide|herbicide|glyphosate|atrazine|organophosph|insecticide"),
    ("Fluorescent reporters",    r"\bgfp\b|\brfp\b|mcherry|sfgfp|egfp|\byfp\b|\bcfp\b|fluorescent protein|luciferase"),
    ("Greenhouse gases",         r"carbon dioxide|\bco2\b|methane|\bch4\b|nitrous oxide|greenhouse"),
    ("Nitrogen compounds",       r"nitrate|nitrite|ammoni|urea|nitrogen"),
    ("Phosphorus compounds",     r"phosphate|phosphorus"),
    ("Sugars & carbohydrates",   r"glucose|sucrose|lactose|xylose|arabinose|fructose|galactose|starch|cellulose|chitin|chitos|glycogen|carbohydrate|\bsugar"),
    ("Alcohols & solvents",      r"ethanol|methanol|butanol|glycerol|isopropanol|acetone|\bsolvent|aldehyde"),
    ("Lipids & oils",            r"lipid|triglycerid|fatty acid|^oils?$|(vegetable|cooking|plant|essential) oil"),
    ("Organic acids",            r"lactic acid|acetic acid|citric acid|succinic|butyric|organic acid|salicyl|formic|formate|uric acid"),
    ("Neurotransmitters",        r"serotonin|dopamine|l-?dopa|\bgaba\b|melatonin|acetylcholine|neurotransmitter"),
    ("Amino acids & peptides",   r"amino acid|tryptophan|tyrosine|glutamate|lysine|peptide|glutathione"),
    ("Nucleic acids",            r"^(dna|rna|mrna|sirna|trna|plasmid dna|cdna)$|nucleic acid|oligonucleotide|mirna|microrna"),
    ("Reactive oxygen species",  r"reactive oxygen|hydrogen peroxide|\bros\b|superoxide|free radical"),
    ("Hormones & steroids",      r"hormone|estrogen|insulin|testosterone|cortisol|steroid|auxin|cholesterol"),
    ("Signalling molecules",     r"\bahl\b|homoserine lactone|quorum|autoinducer|cyclic di|\bcamp\b|\batp\b"),
    ("Toxins & mycotoxins",      r"toxin|aflatoxin|ochratoxin|botulinum|\bricin"),
    ("Dyes & textile waste",     r"\bdye|azo\b|methylene blue|textile"),
    ("Pharmaceutical residues",  r"pharmaceutic|ibuprofen|paracetamol|acetaminophen|diclofenac|caffeine"),
    ("Terpenes & natural products", r"terpene|limonene|carot|lycopene|flavonoid|polyphenol|anthocyanin|natural product|indigo|vanillin|geraniol|naringenin|resveratrol|curcumin|violacein|astaxanthin"),
    ("Pathogens & biomarkers",   r"pathogen|bacteri|virus|sars|staphylococ|biomarker|antigen|pseudomonas|streptococc|escherichia|\be\.? ?coli\b|salmonella|listeria|helicobacter|candida|\bher2\b|tumou?r|cancer|biofilm|antibod"),
    ("Water pollutants (other)", r"pollutant|contaminant|effluent|wastewater|oil spill|petroleum|hydrocarbon|pfas|pfoa|pfos|perfluoro|toluene|benzene|phenol|catechol|alkane|\bbtex\b"),
    ("Physical stimuli",         r"^(light|blue light|red light|green light|near.?infrared( light)?|nir light|temperature|ph|heat|cold|pressure|uv|uv light|uv radiation|sound|ultrasound|magnetic field|electric field|electricity|electrons)$"),
    ("Inducers & signals",       r"\biptg\b|arabinose|nisin|anhydrotetracycline|\batc\b|inducer|\bahl\b"),
    ("Central metabolites",      r"lactate|acetate|pyruvate|butyrate|acetyl-?coa|\bnad[ph]*\b|succinate|malate|citrate"),
    ("Gases (O2/H2/H2S/NO)",     r"^(oxygen|hydrogen|hydrogen sulfide|nitric oxide|\bno\b|\bh2s?\b|\bo2\b|ozone)$|sulfide|sulphide"),
    ("Minerals & salts",         r"\biron\b|calcium|magnesium|potassium|sodium chloride|carbonate|silica|\bsalt\b|mineral"),
    ("Biopolymers & bioplastics", r"polyhydroxy|\bpha\b|\bphb\b|lignin|polyethylene|bioplastic|biopolymer|silk|collagen|keratin"),
    ("Proteins (generic)",       r"^(protein|proteins|enzyme|enzymes|gene expression|fluorescence|biomass)$"),
    ("Vitamins & cofactors",     r"vitamin|folic|folate|riboflavin|cofactor|biotin|heme"),
]

PART = [
    ("Reporter: GFP family",     r"\b(sf)?gfp\b|egfp|gfpmut|green fluorescent|amilgfp|mneongreen|superfolder|\bmgfp\b"),
    ("Reporter: RFP / mCherry",  r"\brfp\b|mcherry|mrfp|dsred|mscarlet|red fluorescent"),
    ("Reporter: other fluorescent", r"\b[ye]fp\b|\bcfp\b|\be[cyb]fp\b|\bbfp\b|mvenus|mturquoise|cerulean|citrine|mclover|morange|fluorescent protein"),
    ("Reporter: LacZ / luciferase", r"lacz|luciferase|\blux[ab]\b|galactosidase|chromoprotein|amilcp"),
    ("Promoter: T7",             r"\bt7\b"),
    ("Promoter: lac / tac",      r"\bp?lac\w*\b.*promoter|promoter.*lac|\bptac\b|\btrc\b|^p ?lac$|\blac ?operator\b|\blaco\b"),
    ("Promoter: tet",            r"\bp?tet\w*\b.*promoter|promoter.*tet|\bptet\b|\bteto\b|tet operator"),
    ("Promoter: ara / rha",      r"\bpbad\b|ara\w*.*promoter|rhamnose promoter"),
    ("Promoter: constitutive",   r"constitutive|j23\d{3}|anderson promoter"),
    ("Promoter: other",          r"promoter"),
    ("Ribosome binding site",    r"\brbs\b|ribosome binding|shine.?dalgarno|b0034|b0032"),
    ("Terminator",               r"terminator|b0015|b0010"),
    ("Regulator / repressor",    r"\blaci\b|\btetr\b|\barac\b|repressor|lambda ci|^ci\d*$|\bgal4\b|\blexa\b"),
    ("Regulator: quorum (Lux)",  r"\blux[ri]\b|\blas[ri]\b|\brhl[ri]\b|\bplux\b|lux operon|\baiia\b|quorum"),
    ("CRISPR: Cas / gRNA",       r"cas9|cas12|cas13|dcas9|\bs?grna\b|guide rna|crispr|crrna"),
    ("Affinity tag",             r"his.?tag|6x?his|\bflag\b|\bmbp\b|\bgst\b|strep.?tag|sumo|\bha.?tag|myc.?tag"),
    ("Signal peptide / secretion", r"signal peptide|secretion|pelb|ompa|tat pathway|\bhly[abd]\b"),
    ("Plasmid backbone",         r"psb\w+|\bpet-?\d|pet ?duet|pcold|pgex|\bpuc\d|pcdf|prsf|pacyc|backbone|\bvector\b|plasmid"),
    ("Restriction enzyme",       r"ecori|psti|xbai|spei|bsai|bsmbi|noti|bamhi|hindiii|ndei|xhoi|restriction enzyme"),
    ("Antimicrobial peptide",    r"ll-?37|nisin|antimicrobial peptide|defensin|bacteriocin|endolysin"),
    ("Enzyme: PETase / MHETase", r"petase|mhetase|cutinase"),
    ("Enzyme: laccase / peroxidase", r"laccase|peroxidase|\bp450\b|monooxygenase|dioxygenase"),
    ("Enzyme: cellulase / amylase", r"cellulase|amylase|xylanase|lipase|protease|chitinase"),
    ("Toxin / kill switch",      r"\bmazf\b|\bmaze\b|\bccdb\b|\bsacb\b|kill switch|toxin.?antitoxin|\brelbe\b|\bmerr\b"),
    ("Enzyme: other",            r"enzyme|\w+ase\b"),
    ("Binding protein / antibody", r"antibody|nanobody|scfv|aptamer|binding protein|receptor|streptavidin|avidin"),
    ("Riboswitch / sRNA",        r"riboswitch|ribozyme|\bsrna\b|aptazyme|toehold|sirna|shrna"),
    ("Degradation tag",          r"\bssra\b|degradation tag|\blva\b"),
    ("Origin of replication",    r"\bori\b|origin of replication|cole1|p15a"),
    ("Selection marker",         r"resistance|\bamp[r]?\b|\bkan[r]?\b|selection marker|\bura3\b|\bleu2\b|\bhis3\b|auxotroph"),
    ("Protein conjugation (Spy)", r"spytag|spycatcher|sortase|\bintein"),
    ("Recombinase site (lox/FRT)", r"\bloxp\b|\bfrt\b|recombinase|\bcre\b"),
    ("Inducer molecule",         r"^(iptg|ahl|arabinose|atc|anhydrotetracycline|biotin)$"),
    ("Registry / BioBrick part", r"^bba[ _-]?[a-z]?\d+|^biobricks?$"),
]

RULES = {"domain": DOMAIN, "technique": TECHNIQUE, "chassis": CHASSIS, "molecule": MOLECULE, "part": PART}

# Labels of metadata.
REGION_LABEL = {
    "asia": "Asia", "north-america": "North America", "europe": "Europe",
    "latin-america": "Latin America", "oceania": "Oceania", "africa": "Africa",
}
SECTION_LABEL = {
    "undergrad": "Undergraduate", "overgrad": "Overgraduate", "high-school": "High school",
}
COUNTRY_LABEL = {
    "ARE": "United Arab Emirates", "ARG": "Argentina", "AUS": "Australia", "AUT": "Austria",
    "BEL": "Belgium", "BGR": "Bulgaria", "BOL": "Bolivia", "BRA": "Brazil", "CAN": "Canada",
    "CHE": "Switzerland", "CHL": "Chile", "CHN": "China", "COD": "DR Congo", "COL": "Colombia",
    "CRI": "Costa Rica", "CZE": "Czechia", "DEU": "Germany", "DNK": "Denmark", "ECU": "Ecuador",
    "EGY": "Egypt", "ESP": "Spain", "EST": "Estonia", "FIN": "Finland", "FRA": "France",
    "GBR": "United Kingdom", "GHA": "Ghana", "GRC": "Greece", "HKG": "Hong Kong",
    "HND": "Honduras", "HUN": "Hungary", "IDN": "Indonesia", "IND": "India", "IRL": "Ireland",
    "ISR": "Israel", "ITA": "Italy", "JPN": "Japan", "KAZ": "Kazakhstan", "KEN": "Kenya",
    "KOR": "South Korea", "KWT": "Kuwait", "LTU": "Lithuania", "LVA": "Latvia", "MAC": "Macau",
    "MEX": "Mexico", "NLD": "Netherlands", "NOR": "Norway", "NPL": "Nepal",
    "NZL": "New Zealand", "PAK": "Pakistan", "PAN": "Panama", "PER": "Peru", "POL": "Poland",
    "PRI": "Puerto Rico", "PRT": "Portugal", "QAT": "Qatar", "ROU": "Romania",
    "RUS": "Russia", "SAU": "Saudi Arabia", "SGP": "Singapore", "SVN": "Slovenia",
    "SWE": "Sweden", "THA": "Thailand", "TUR": "Turkey", "TWN": "Taiwan", "UGA": "Uganda",
    "USA": "United States", "ZAF": "South Africa",
}

# Words kept in capitals, and names too general to count.
KEEP_UPPER = {"dna", "rna", "pcr", "gfp", "rfp", "hplc", "elisa", "crispr", "3d", "uv", "ph"}
GENERIC = {
    "chassis": {"synthetic biology"},
    "technique": {"experimental validation", "experimental design", "expression", "incubation"},
    "molecule": {"metabolites", "nutrients"},
    "part": {"reporter gene", "reporter genes", "linker", "linkers"},
}

# Topics, and what older names and domains became.
VILLAGES = {
    "Agriculture", "Art & Design", "Biomanufacturing", "Bioremediation",
    "Climate Crisis", "Conservation", "Diagnostics", "Fashion & Cosmetics",
    "Food & Nutrition", "Foundational Advance", "Infectious Diseases",
    "Oncology", "Software & AI", "Space", "Therapeutics",
}
OLD_TRACK = {
    "Health & Medicine": "Therapeutics",
    "Manufacturing": "Biomanufacturing",
    "Software": "Software & AI",
    "Energy": "Climate Crisis",
    "Information Processing": "Foundational Advance",
    "Measurement": "Foundational Advance",
    "Hardware": "Foundational Advance",
    "Microfluidics": "Foundational Advance",
}
DOMAIN_VILLAGE = {
    "Diagnostics": "Diagnostics",
    "Biosensors": "Diagnostics",
    "Biomanufacturing": "Biomanufacturing",
    "Biomaterials": "Biomanufacturing",
    "Bioremediation": "Bioremediation",
    "Therapeutics": "Therapeutics",
    "Foundational tools": "Foundational Advance",
    "Synthetic biology": "Foundational Advance",
    "Agriculture & food": "Agriculture",
    "Energy": "Climate Crisis",
}

# Forms of one term, each of which finds all.
SYNONYMS = [
    ("escherichia coli", "ecoli"),
    ("saccharomyces cerevisiae", "scerevisiae", "budding yeast"),
    ("bacillus subtilis", "bsubtilis"),
    ("pseudomonas putida", "pputida"),
    ("green fluorescent protein", "gfp", "sfgfp", "egfp"),
    ("red fluorescent protein", "rfp", "mcherry", "mrfp"),
    ("polymerase chain reaction", "pcr"),
    ("gel electrophoresis", "electrophoresis"),
    ("ribosome binding site", "rbs"),
    ("clustered regularly interspaced short palindromic repeats", "crispr"),
    ("golden gate", "goldengate"),
    ("heavy metal", "heavy metals"),
    ("polyethylene terephthalate", "pet plastic"),
    ("quorum sensing", "quorum", "qs"),
    ("bacillus thuringiensis", "bt"),
    ("site directed mutagenesis", "sitedirected mutagenesis"),
    ("western blot", "western blotting", "immunoblot"),
    ("flow cytometry", "facs"),
    ("mass spectrometry", "mass spec"),
    ("high performance liquid chromatography", "hplc"),
    ("enzyme linked immunosorbent assay", "elisa"),
]

# Long forms and their abbreviations; only the abbreviation finds both.
ABBREVIATIONS = [
    ("adaptive laboratory evolution", "ale"),
    ("african swine fever", "asf"),
    ("amoebic gill disease", "agd"),
    ("amyotrophic lateral sclerosis", "als"),
    ("anaerobic fluorescent protein", "afp"),
    ("antifungal porphyrin based intervention system", "apis"),
    ("aptamer lateral flow assay", "alfa"),
    ("arsenic binding peptide", "abp"),
    ("autism spectrum disorder", "asd"),
    ("bacillus thuringiensis", "bt"),
    ("bacterial cellulose", "bc"),
    ("bacterial leaf blight", "blb"),
    ("banana xanthomonas wilt", "bxw"),
    ("batrachochytrium dendrobatidis", "bd"),
    ("beet yellows virus", "byv"),
    ("biofrag isolation unit", "biu"),
    ("bovine respiratory disease", "brd"),
    ("burst size distribution", "bsd"),
    ("buruli ulcer", "bu"),
    ("carbonic anhydrase", "ca"),
    ("catalytic hairpin assembly", "cha"),
    ("cellulose binding domain", "cbd"),
    ("chimeric antigen receptor", "car"),
    ("chronic inflammatory diseases", "cid"),
    ("chronic kidney disease", "ckd"),
    ("chronic lymphocytic leukemia", "cll"),
    ("circular polymerase extension cloning", "cpec"),
    ("circulating tumor cell", "ctc"),
    ("colony collapse disorder", "ccd"),
    ("continuous directed evolution", "cde"),
    ("coronary artery disease", "cad"),
    ("cyclic chain displacement reaction", "ccdr"),
    ("cysteine sulfinic acid decarboxylase", "csad"),
    ("cystic fibrosis", "cf"),
    ("cytochrome maturation", "ccm"),
    ("deformed wing virus", "dwv"),
    ("degradation tag", "dt"),
    ("deinococcus radiodurans", "dr"),
    ("diabetic nephropathy", "dn"),
    ("diffusible signaling factor", "dsf"),
    ("digital in line holographic microscope", "dihm"),
    ("double vector system", "dvs"),
    ("dystrophic epidermolysis bullosa", "deb"),
    ("electrochemical impedance spectroscopy", "eis"),
    ("emerald ash borer", "eab"),
    ("enhanced yellow fluorescent protein", "eyfp"),
    ("enzymatic fuel cell", "efc"),
    ("enzymatic microbial fuel cell", "emfc"),
    ("enzyme fragment complementation assay", "efca"),
    ("enzyme replacement therapy", "ert"),
    ("epidermal growth factor", "egf"),
    ("ethylene glycol", "eg"),
    ("exocrine pancreatic insufficiency", "epi"),
    ("feed forward loop", "ffl"),
    ("finite state automaton", "fsa"),
    ("fluorescence resonance energy transfer", "fret"),
    ("flux balance analysis", "fba"),
    ("fusarium head blight", "fhb"),
    ("generalized additive models", "gam"),
    ("glucocorticoid receptor", "gr"),
    ("green fluorescent protein", "gfp"),
    ("health risk detection kit", "hrdk"),
    ("heat shock protein", "hsp"),
    ("hepatic encephalopathy", "he"),
    ("hepatitis virus", "hbv"),
    ("hepatitis virus", "hcv"),
    ("hereditary fructose intolerance", "hfi"),
    ("horizontal gene transfer", "hgt"),
    ("human chorionic gonadotropin", "hcg"),
    ("human estrogen receptor", "her"),
    ("human gastric intrinsic factor", "hgif"),
    ("human serum albumin", "hsa"),
    ("hyaluronic acid", "ha"),
    ("hybridization chain reaction", "hcr"),
    ("ice nucleation protein", "inp"),
    ("idealized protein purification", "ipp"),
    ("idiopathic pulmonary fibrosis", "ipf"),
    ("inflammatory bowel disease", "ibd"),
    ("integrated human practices", "ihp"),
    ("intrinsic factor", "if"),
    ("invasive candidiasis", "ic"),
    ("irritable bowel syndrome", "ibs"),
    ("iterative capped assembly", "ica"),
    ("lactic acid mediated", "lam"),
    ("lateral flow assay", "lfa"),
    ("leaf compost cutinase", "lcc"),
    ("lethal toxin neutralizing factor", "ltnf"),
    ("ligase chain reaction", "lcr"),
    ("live biotherapeutic product", "lbp"),
    ("localized surface plasmon resonance", "lspr"),
    ("logical genetic diagram", "lgd"),
    ("major depressive disorder", "mdd"),
    ("maple syrup urine disease", "msud"),
    ("methicillin resistant staphylococcus aureus", "mrsa"),
    ("microbial desalination cell", "mdc"),
    ("microbial enhanced oil recovery", "meor"),
    ("microbial fuel cell", "mfc"),
    ("microbially induced calcite precipitation", "micp"),
    ("mild traumatic brain injury", "mtbi"),
    ("mini bioproduction cycle system", "mbcs"),
    ("modular receptor platform", "mrp"),
    ("mountain pine beetle", "mpb"),
    ("multiplex automated genome engineering", "mage"),
    ("mussel foot protein", "mfp"),
    ("nitric oxide", "no"),
    ("nuclear receptor", "nr"),
    ("oak processionary caterpillar", "opc"),
    ("oil mill wastewater", "omw"),
    ("open sequence format", "osf"),
    ("oral squamous cell carcinoma", "oscc"),
    ("paper analytical device", "pad"),
    ("paralytic shellfish poisoning", "psp"),
    ("pattern recognition receptor", "prr"),
    ("pernicious anaemia", "pa"),
    ("phenylalanine ammonia lyase", "pal"),
    ("phosphate binding protein", "pbp"),
    ("poly lactic acid", "pla"),
    ("precipitated calcium carbonate", "pcc"),
    ("protective phytochemical quantifier", "ppq"),
    ("protein degradation tags", "pdt"),
    ("pyruvate dehydrogenase complex", "pdc"),
    ("quartz crystal microbalance", "qcm"),
    ("quorum sensing", "qs"),
    ("random positioning machine", "rpm"),
    ("reactive oxygen species", "ros"),
    ("recombinant epidermal growth factor", "regf"),
    ("recombinase polymerase amplification", "rpa"),
    ("recombination directionality factor", "rdf"),
    ("red fluorescent protein", "rfp"),
    ("reduced graphene oxide", "rgo"),
    ("regulatory flux balance analysis", "rfba"),
    ("rheumatoid arthritis", "ra"),
    ("ribosome binding site", "rbs"),
    ("rna iii inhibiting peptide", "rip"),
    ("rolling circle amplification", "rca"),
    ("rolling circle replication", "rcr"),
    ("rotating biological contactor", "rbc"),
    ("salicylic acid", "sa"),
    ("small heat shock proteins", "shsp"),
    ("soil based microbial fuel cell", "smfc"),
    ("spinal cord injury", "sci"),
    ("stony coral tissue loss disease", "sctld"),
    ("stop codon readthrough", "scr"),
    ("sulfide quinone reductase", "sqr"),
    ("sustainable aviation fuel", "saf"),
    ("synthetic expression system", "ses"),
    ("terminal deoxynucleotidyl transferase", "tdt"),
    ("tetracycline mimic inhibitor peptide", "tip"),
    ("tobacco mosaic virus", "tmv"),
    ("tomato spotted wilt virus", "tswv"),
    ("toxic shock syndrome", "tss"),
    ("transmembrane readiness framework", "trf"),
    ("trigger factor", "tf"),
    ("triple negative breast cancer", "tnbc"),
    ("tyrosine ammonia lyase", "tal"),
    ("universal bacterial expression resource", "uber"),
    ("unnatural amino acid", "uaa"),
    ("uric acid", "ua"),
    ("west nile virus", "wnv"),
    ("white nose syndrome", "wns"),
    ("yellow fluorescent protein", "yfp"),
    ("zosteric acid", "za"),
]

# Abbreviations that are common words.
COMMON_WORDS = {"her", "tip", "pad", "rip", "lam", "gam", "cad"}

# Page names that are no team, as slugs.
NOT_TEAMS = {
    "", "acknowledgement", "acknowledgements", "banner", "biosafety", "safety",
    "template", "templates", "main", "home", "index", "test", "sandbox",
    "notebook", "results", "team", "teams", "project", "collaborations",
    "humanpractices", "attributions", "judging", "medals", "sponsors",
    "example", "example2", "example3", "gallery", "teamname", "yourteam",
    "placeholder", "untitled", "demo", "wikitemplate", "xyzlink",
}

# Words that no long form starts with.
LEAD_WORDS = frozenset(
    """
    a an the to of in on for with by using use develop developed developing produce produced producing create created creating based and or that
    this these those we our their its is are was were as at from into through
    """.split()
)

# Words that concepts leave out, and terms that stay however frequent.
STOPWORDS = frozenset(
    """
    a an and are as at be by for from has have had he her his in into is it its of on or that the their them they this to was were will with we
    our us you your i me my be been being do does did doing but not no nor so than then too very can could should would may might must shall
    about above after again against all any because before below between both during each few more most other some such only own same s t just
    don now which who whom what when where why how here there project team teams wiki page year university student students member members http
    https www com org html index home overview description introduction
    """.split()
)
KEEP_TERMS = frozenset(
    """
    coli escherichia bacteria bacterial cell cells gene genes genetic protein proteins dna rna plasmid promoter enzyme enzymes sequence
    expression bacterium yeast biosensor pathway metabolic synthetic bacteriophage phage antibiotic
    """.split()
)
