"""Word lists, tables and constants that define the default query and its features."""

from __future__ import annotations

# ---- Fixed values: tokenising -------------------------------------------------------------------------------------
TOKEN = "[a-z0-9_+#.]+"
STOPWORDS = """a an and are as at be by for from has he in is it its of on that the to was were will with i you they we
this or but not what all when there can your which their said if do each about how up out them then she many some so
these would other into more her two like him see time could no make than first been who now people my made over down
only way find use may water long little very after words called just where most know""".split()
PHRASES = [
    "a/b testing", "ann search", "candidate fit", "candidate matching", "context aware", "dense retrieval",
    "hybrid search", "information retrieval", "learning to rank", "neural representations", "prompt engineering",
    "recommendation system", "search relevance", "semantic search", "similar items", "vector database",
    "vector representations", "vector search",
]
CONCEPTS = {
    "retrieval_system": ["find similar", "similar items", "similar candidates", "semantic search", "search relevance", "relevance search", "nearest neighbor", "dense retrieval", "neural retrieval", "retrieval system"],
    "vector_database": ["faiss", "pinecone", "weaviate", "qdrant", "milvus", "pgvector", "vector store", "vector db", "vector database", "vector search", "ann search", "hnsw"],
    "rag_system": ["context aware conversational", "knowledge grounded", "grounded generation", "retrieval augmented", "llm with search", "chatbot with search", "conversational system", "langchain", "llamaindex", "agentic"],
    "recommendation_system": ["recommendation system", "recommender", "personalization", "personalized feed", "relevant items", "ranking feed", "matching engine", "candidate fit", "talent matching"],
    "evaluation": ["ndcg", "mrr", "map", "precision at", "recall at", "offline evaluation", "online evaluation", "a/b testing", "ranking metrics"],
}
#: The default query; the name of an employer is left out.
DEFAULT_QUERY = """Senior AI Engineer founding team AI production embeddings retrieval ranking
candidate matching hybrid search vector database BM25 semantic search LLM reranking
Python evaluation framework NDCG MRR MAP A/B testing product engineering applied
machine learning NLP information retrieval recommender search systems shipped users scale
similar items neural representations context aware conversational system personalization
candidate fit talent matching marketplace relevance search concept_retrieval_system
concept_vector_database concept_rag_system concept_recommendation_system concept_evaluation."""

# ---- Fixed values: skills -----------------------------------------------------------------------------------------
MUST = {
    "embeddings_retrieval": ["sentence-transformers", "sentence transformers", "openai embeddings", "bge", "e5", "embedding", "embeddings", "text embedding", "dense retrieval", "semantic search", "bi-encoder", "dual encoder", "vector representations"],
    "vector_database": ["pinecone", "weaviate", "qdrant", "milvus", "faiss", "opensearch", "elasticsearch", "pgvector", "chroma", "vector search", "vector database", "vector store", "vector db", "ann", "ann search", "hnsw", "approximate nearest neighbor"],
    "ranking_information_retrieval": ["ranking", "retrieval", "information retrieval", "learning to rank", "ltr", "reranking", "re-ranking", "cross-encoder", "recommendation system", "recommender", "search relevance", "relevance ranking", "ndcg", "mrr", "map", "precision@k", "recall@k"],
    "llm_production": ["llm", "large language model", "genai", "generative ai", "agents", "agentic", "prompt engineering", "langchain", "llamaindex", "rag", "retrieval augmented generation", "fine-tuning", "fine tuning", "lora", "qlora", "peft", "instruction tuning"],
    "python_ml_engineering": ["python", "pytorch", "tensorflow", "sklearn", "scikit-learn", "huggingface", "transformers", "numpy", "pandas", "xgboost", "lightgbm", "fastapi", "flask"],
    "eval_frameworks": ["ndcg", "mrr", "map", "mean average precision", "a/b test", "ab test", "a/b testing", "offline evaluation", "online evaluation", "benchmark", "ranking metrics", "retrieval metrics"],
}
MUST_WEIGHTS = {"embeddings_retrieval": 0.25, "vector_database": 0.20, "ranking_information_retrieval": 0.25, "llm_production": 0.12, "python_ml_engineering": 0.12, "eval_frameworks": 0.06}
NICE = {
    "lora_finetuning": ["lora", "qlora", "peft", "fine-tuning llms", "finetuning"],
    "learning_to_rank": ["xgboost", "lightgbm", "ltr", "learning to rank", "lambdamart"],
    "distributed_systems": ["spark", "kafka", "flink", "ray", "dask", "distributed"],
    "marketplace_hrtech": ["hr-tech", "hr tech", "recruiting", "talent", "marketplace"],
    "open_source": ["github", "open source", "open-source", "contributed", "maintainer"],
}
PROFICIENCY = {"beginner": 0.35, "intermediate": 0.6, "advanced": 0.85, "expert": 1.0}
EXPECTED_ASSESSMENT = {"beginner": 30.0, "intermediate": 50.0, "advanced": 70.0, "expert": 85.0}

# ---- Fixed values: employers, places, titles, education -----------------------------------------------------------
PRODUCT_COMPANIES = [
    "cred", "flipkart", "swiggy", "zomato", "razorpay", "paytm", "phonepe", "meesho", "freshworks", "zoho", "ola", "google",
    "amazon", "microsoft", "apple", "adobe", "linkedin", "netflix", "uber", "meta", "openai", "anthropic", "databricks",
    "atlassian", "shopify", "stripe", "twilio", "nvidia", "bytedance", "samsung", "intel", "hooli", "initech", "globex inc",
    "stark industries", "wayne enterprises", "acme corp", "dunder mifflin",
]
PRODUCT_INDUSTRIES = ["software", "fintech", "saas", "ecommerce", "e-commerce", "edtech", "healthtech", "gaming", "marketplace", "ai", "ml", "data", "platform"]
TECH_INDUSTRIES = ["software", "tech", "data", "platform"]
PRODUCT_SIZES = ["51-200", "201-500", "501-1000", "1001-5000", "5001-10000", "10001+"]
SERVICES = ["tcs", "infosys", "wipro", "accenture", "cognizant", "capgemini", "mindtree", "hcl", "tech mahindra"]
PLACES = ["pune", "noida", "delhi", "ncr", "gurgaon", "gurugram", "mumbai", "hyderabad", "bangalore", "bengaluru"]
TITLES = {
    "lead ai engineer": 1.0, "staff machine learning engineer": 1.0, "senior machine learning engineer": 1.0, "senior ai engineer": 1.0,
    "machine learning engineer": 0.95, "ml engineer": 0.95, "applied ml engineer": 0.95, "recommendation systems engineer": 0.95,
    "search engineer": 0.95, "senior nlp engineer": 0.9, "nlp engineer": 0.88, "senior data scientist": 0.78, "data scientist": 0.72,
    "data engineer": 0.65, "backend engineer": 0.58, "software engineer": 0.52, "cloud engineer": 0.42, "devops engineer": 0.38,
    "full stack developer": 0.34, "java developer": 0.28, ".net developer": 0.25, "frontend engineer": 0.18, "mobile developer": 0.16,
}
OTHER_TITLES = ["marketing manager", "hr manager", "accountant", "graphic designer", "content writer", "sales executive", "civil engineer", "mechanical engineer", "customer support", "operations manager"]
SENIOR = ["senior", "staff", "lead", "principal"]
JUNIOR = ["junior", "intern", "trainee", "associate", "fresher"]
STUDY_FIELDS = ["computer", "artificial intelligence", "data science", "statistics", "mathematics", "information technology"]
DEGREES = ["m.tech", "m.e", "m.s", "m.sc", "ph.d", "phd"]

# ---- Fixed values: evidence in texts ------------------------------------------------------------------------------
RETRIEVAL_TERMS = ["ranking", "retrieval", "search", "recommendation", "recommender", "ranker", "indexing", "similarity search", "vector search", "semantic search", "relevance", "recall", "precision", "ndcg", "mrr", "bm25", "tf-idf"]
PRODUCTION_TERMS = ["shipped", "deployed", "production", "launched", "users", "latency", "throughput", "serving", "inference", "monitoring", "on-call", "real-time", "a/b", "ab test", "low latency", "high throughput", "production system", "production ml"]
SCALE_TERMS = ["million", "billion", "petabyte", "terabyte", "100k", "1m", "10m", "at scale", "high throughput", "low latency", "500gb"]
CODE_TERMS = ["python", "implemented", "built", "coded", "developed", "microservice", "production code", "spring boot", "fastapi", "flask", "rest api", "grpc", "backend service"]
OPEN_SOURCE_TERMS = ["open source", "open-source", "github", "maintainer", "contributed", "pull request", "public repo", "huggingface", "arxiv preprint"]
RESEARCH_TERMS = ["research lab", "academic", "arxiv", "paper", "publication", "dissertation", "postdoc", "professor", "university research"]
VISION_TERMS = ["image classification", "computer vision", "opencv", "speech recognition", "tts", "text to speech", "gan", "gans", "robotics"]
WRAPPER_TERMS = ["langchain", "llamaindex", "llama index", "prompt engineering", "prompt chaining"]
LEARNING_TERMS = ["machine learning", "ai", "ml", "nlp", "data science"]

# ---- Fixed values: weights and gates ------------------------------------------------------------------------------
WEIGHTS = {
    "bm25_score": 0.10, "core_skill_match": 0.15, "nice_skill_match": 0.04, "skill_depth_score": 0.06, "endorsement_trust": 0.02,
    "assessment_score_avg": 0.02, "github_signal": 0.02, "product_company_ratio": 0.09, "ir_ranking_experience": 0.12,
    "production_evidence": 0.13, "senior_title_held": 0.04, "career_trajectory_score": 0.07, "scale_signal": 0.03,
    "code_writing_recent": 0.04, "yoe_fit_score": 0.06, "education_score": 0.02, "ml_ai_tenure_score": 0.04,
    "open_source_signal": 0.01, "location_score": 0.05, "relocation_willing": 0.01, "notice_period_score": 0.01, "hyre_similarity": 0.05,
}
TOP23 = {"ir_ranking_experience": 1.50, "yoe_fit_score": 2.00, "location_score": 1.50, "senior_title_held": 1.50, "core_skill_match": 0.50, "assessment_score_avg": 0.00}
UNIVERSAL = {
    "ir_ranking_experience": 0.83527, "yoe_fit_score": 4.30920, "location_score": 0.67094, "senior_title_held": 1.40042,
    "core_skill_match": 0.46425, "assessment_score_avg": 0.18542, "production_evidence": 2.35747, "career_trajectory_score": 0.40158,
    "product_company_ratio": 1.45178, "skill_depth_score": 1.68406,
}
#: Profile: the weights' factors and the exponent on the behaviour multiplier.
PROFILES = {"main": ({}, 1.0), "top23-clean": (TOP23, 0.35), "universal-v2": (UNIVERSAL, 0.31065)}
SEMANTIC_WEIGHT = 0.10
FEATURES = [
    "core_skill_match", "jd_keyword_coverage_score", "nice_skill_match", "skill_depth_score", "endorsement_trust",
    "assessment_score_avg", "disqualifier_skill_flag", "keyword_stuffer_flag", "github_signal", "product_company_ratio",
    "consulting_only_flag", "ir_ranking_experience", "production_evidence", "title_match_score", "senior_title_held",
    "career_trajectory_score", "scale_signal", "code_writing_recent", "yoe_fit_score", "education_score", "ml_ai_tenure_score",
    "open_source_signal", "availability_score", "engagement_score", "responsiveness_score", "interview_reliability",
    "profile_quality", "notice_period_score", "location_score", "relocation_willing", "backend_depth_score",
    "data_bi_depth_score", "hyre_similarity",
]
DISQUALIFIERS = {
    "pure_research_without_deployment": 0.45, "cv_speech_robotics_primary": 0.60, "keyword_stuffer": 0.70, "title_hopper": 0.90,
    "salary_inversion": 0.65, "endorsement_inflation_low_profile": 0.70, "llm_wrapper_only": 0.82, "junior_for_senior_role": 0.88,
    "hidden_text_control_chars": 0.82, "prompt_injection_text": 0.55, "repeated_keyword_block": 0.65,
}
SOFT_HONEYPOTS = ["career_history_too_short_for_claimed_yoe", "expert_skill_zero_duration", "summary_career_yoe_contradiction"]
REFERENCE_DATE = "2026-06-08"

# ---- Fixed values: integrity of texts -----------------------------------------------------------------------------
HIDDEN = r"[​-‏‪-‮⁦-⁩﻿]"
INJECTION = r"(ignore|disregard|forget)\s+(all\s+)?(previous|prior|above)\s+(instructions|prompts|rules)|system\s+prompt|developer\s+message|you\s+are\s+chatgpt|rank\s+me\s+(first|top)|give\s+me\s+(rank|score)\s*(1|one|100)"
INJECTION_MARKERS = ["ignore", "disregard", "forget", "system prompt", "developer message", "chatgpt", "rank me", "score 100", "score one", "give me score"]
KEYWORDS = ["python", "rag", "llm", "embedding", "embeddings", "vector", "search", "ranking", "ranker", "faiss", "milvus", "qdrant", "langchain", "retrieval"]

# ---- Fixed values: first year of a technology ---------------------------------------------------------------------
TECHNOLOGIES = {
    "RAG": (r"\brag\b|retrieval[- ]augmented", 2020), "LangChain": (r"\blangchain\b", 2022), "LlamaIndex": (r"\bllama[- ]?index\b|\bgpt[- ]?index\b", 2022),
    "LangGraph": (r"\blanggraph\b", 2024), "ChatGPT": (r"\bchatgpt\b", 2022), "GPT-4": (r"\bgpt[- ]?4\b", 2023), "GPT-3": (r"\bgpt[- ]?3\b", 2020),
    "GPT-3.5": (r"\bgpt[- ]?3\.5\b", 2022), "DALL-E": (r"\bdall[- ]?e\b", 2021), "Stable Diffusion": (r"stable diffusion", 2022),
    "Midjourney": (r"\bmidjourney\b", 2022), "Whisper": (r"\bwhisper\b", 2022), "LoRA": (r"\blora\b", 2021), "QLoRA": (r"\bqlora\b", 2023),
    "PEFT": (r"\bpeft\b", 2022), "vLLM": (r"\bvllm\b", 2023), "Ollama": (r"\bollama\b", 2023), "DSPy": (r"\bdspy\b", 2023),
    "AutoGen": (r"\bautogen\b", 2023), "CrewAI": (r"\bcrewai\b", 2023), "Claude (LLM)": (r"\bclaude\b", 2023), "Gemini (LLM)": (r"\bgemini\b", 2023),
    "LLaMA": (r"\bllama\b(?![- ]?index)", 2023), "Mistral": (r"\bmistral\b|\bmixtral\b", 2023), "Pinecone": (r"\bpinecone\b", 2019),
    "Weaviate": (r"\bweaviate\b", 2019), "Qdrant": (r"\bqdrant\b", 2021), "Chroma DB": (r"\bchroma\s?db\b|\bchromadb\b", 2022),
    "Milvus": (r"\bmilvus\b", 2019), "vector database": (r"vector (database|db|search|store)", 2019),
    "Sentence Transformers": (r"sentence[- ]?transformers?\b|\bsbert\b", 2019), "Prompt Engineering": (r"prompt engineering", 2021), "InstructGPT": (r"\binstructgpt\b", 2022),
}
TECHNOLOGY_YEAR, TECHNOLOGY_SLACK = 2026, 12

# ---- Fixed values: what an ideal record of a role says ------------------------------------------------------------
ROLE_TEMPLATES = {
    "AI/ML Engineer": """Senior AI/ML Engineer with 6+ years of experience building and deploying scalable machine learning models.
Expert in PyTorch, TensorFlow, and HuggingFace.
Strong background in natural language processing (NLP), large language models (LLMs), and retrieval-augmented generation (RAG).
Production experience serving models with FastAPI, ONNX, and TensorRT on AWS/GCP.
Deep understanding of vector databases (Pinecone, Milvus, Qdrant) and semantic search architectures.
Track record of publishing research or contributing to open-source ML projects.""",
    "Backend Engineer": """Senior Backend Engineer with 8+ years of experience designing high-throughput, low-latency distributed systems.
Expert in Go, Java, Python, and C++.
Deep expertise in microservices architecture, gRPC, REST APIs, and event-driven systems (Kafka, RabbitMQ).
Strong database skills including PostgreSQL, MySQL, Redis, and Cassandra at petabyte scale.
Experience with cloud-native infrastructure, Kubernetes, Docker, and CI/CD pipelines.
Proven ability to optimize system performance, handle concurrency, and ensure 99.99% uptime.""",
    "Data/BI Engineer": """Senior Data Engineer / BI Developer with 7+ years of experience building scalable data pipelines and analytics platforms.
Expert in SQL, Python, Scala, and PySpark.
Deep experience with modern data stack tools: Snowflake, BigQuery, dbt, Airflow, and Fivetran.
Strong background in data modeling, ETL/ELT architecture, and streaming data (Kafka, Flink).
Proficient in data visualization and business intelligence tools like Tableau, Looker, or PowerBI.
Track record of delivering actionable insights and driving data-informed business decisions.""",
    "DevOps/SRE": """Senior Site Reliability Engineer / DevOps with 7+ years of experience managing global cloud infrastructure.
Expert in AWS, GCP, Azure, and infrastructure as code (Terraform, CloudFormation).
Deep expertise in container orchestration (Kubernetes, EKS, GKE) and CI/CD (GitHub Actions, Jenkins, GitLab).
Strong scripting skills in Python, Go, and Bash.
Experience with monitoring and observability tools (Datadog, Prometheus, Grafana, ELK stack).
Proven track record of implementing zero-downtime deployments, auto-scaling, and incident response.""",
    "Search/Ranking": """Senior Search and Ranking Engineer with 6+ years of experience building scalable search engines and recommendation systems.
Expert in Elasticsearch, Solr, OpenSearch, and Lucene internals.
Deep background in Information Retrieval (IR), BM25, TF-IDF, and learning-to-rank (LTR) algorithms.
Experience with e-commerce product search, query understanding, spell correction, and autocomplete.
Strong ML skills applied to personalization, collaborative filtering, and two-tower neural retrieval models.
Proficient in Java, Python, and C++ for high-performance retrieval systems.""",
}

# ---- Fixed values: depth in other roles: terms of each category and how many are deep -----------------------------
BACKEND_DEPTH = {
    "api": (["rest api", "restful api", "api gateway", "graphql", "grpc", "websocket", "microservice", "microservices", "service", "platform", "backend", "spring boot", "fastapi", "flask", "django", "express", "nodejs", "node js"], 3.0),
    "db": (["postgres", "postgresql", "mysql", "mongodb", "cassandra", "dynamodb", "redis", "kafka", "rabbitmq", "sql", "database", "caching", "cache", "sharding", "partitioning", "replica", "read replica"], 3.0),
    "scale": (["qps", "rps", "p99", "p95", "latency", "throughput", "scale", "scaled", "million", "millions", "high availability", "fault tolerant", "load balancing", "horizontal scaling", "rate limiting", "concurrent"], 2.0),
    "infra": (["docker", "kubernetes", "terraform", "aws", "azure", "gcp", "ci cd", "ci/cd", "jenkins", "github actions", "deployment", "deployments"], 3.0),
}
BACKEND_DELIVERY = ["api", "apis", "rest api", "microservice", "microservices", "distributed", "kafka", "spark", "production", "deployed", "shipped", "launched", "latency", "throughput", "scale", "scaled", "service", "services", "platform"]
BACKEND_TITLES = ["senior backend engineer", "staff backend engineer", "principal backend engineer", "backend engineer", "platform engineer", "api developer"]
BACKEND_SURFACE = [
    "api", "rest", "restful", "graphql", "grpc", "json", "xml", "http", "https", "oauth", "jwt", "sso", "authentication", "authorization", "backend",
    "server side", "server", "microservice", "microservices", "service", "services", "endpoint", "endpoints", "middleware", "database", "db", "sql",
    "nosql", "postgres", "postgresql", "mysql", "mongodb", "redis", "cassandra", "dynamodb", "sqlite", "oracle", "mssql", "elasticsearch", "cache", "caching",
    "memcached", "kafka", "rabbitmq", "sqs", "sns", "message queue", "event", "pubsub", "pub sub", "docker", "kubernetes", "k8s", "ci cd", "ci/cd",
    "jenkins", "gitlab", "github actions", "terraform", "ansible", "aws", "gcp", "azure", "cloud", "ec2", "s3", "lambda", "java", "spring", "spring boot",
    "hibernate", "jpa", "maven", "gradle", "python", "django", "flask", "fastapi", "celery", "nodejs", "node js", "express", "nestjs", "typescript",
    "go", "golang", "gin", "ruby", "rails", "php", "laravel", "symfony", "c#", ".net", "asp.net", "git", "github", "bitbucket", "agile", "scrum", "jira",
    "confluence", "unit test", "integration test", "tdd", "bdd", "swagger", "postman", "openapi",
]
DATA_DEPTH = {
    "sql": (["sql", "window function", "cte", "partition by", "rank", "dense rank", "lead", "lag", "query optimization", "stored procedure", "index tuning"], 2.0),
    "warehouse": (["data warehouse", "data warehousing", "snowflake", "bigquery", "redshift", "databricks", "star schema", "fact table", "dimension table", "dbt"], 2.0),
    "viz": (["tableau", "power bi", "looker", "metabase", "superset", "dashboard", "executive dashboard", "self service", "reporting", "kpi", "metrics"], 2.0),
    "etl": (["etl", "elt", "data pipeline", "pipelines", "airflow", "prefect", "dagster", "fivetran", "scheduled refresh", "data quality", "data model", "data modeling"], 2.0),
    "impact": (["stakeholder", "stakeholders", "business users", "executives", "saved", "automated reporting", "hours per week", "decision", "revenue", "cost reduction", "self service", "adoption"], 2.0),
}
DATA_TITLES = ["senior data analyst", "data analyst", "business intelligence developer", "bi developer", "analytics engineer", "data engineer", "business analyst", "reporting analyst"]
